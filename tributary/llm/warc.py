"""WARC archives with revisit records, and the external merge of their capture indexes.

Records are built and parsed with DataFrame functions. An archive part is a plain WARC/1.1 file: the text
writer puts CRLF CRLF after each record, and the reader takes CRLF CRLF "WARC/1.1" CRLF as what parts records.
A payload that holds "WARC/1.1" anywhere is sent with Transfer-Encoding: chunked, a chunk border inside it, so a block
never holds it, whatever stands before or behind; the chunk extension names the payload's own digest, so that no payload
can imitate the border."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tributary.llm import common

CRLF = "\r\n"
VERSION = "WARC/1.1"
BORDER = CRLF + CRLF + VERSION + CRLF
HEAD, TAIL = VERSION[:2], VERSION[2:]
#: Captures that one task of the index merge holds at most, about.
MERGE_ROWS = 100_000
#: Captures in a locally sorted run.
RUN_ROWS = 50_000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(c: Column) -> Column:
    """Upper-case base32 of a string's SHA-1: 160 bits are eight groups of 20 bits, four digits each."""
    sha = F.sha1(c)
    digits = F.concat(*[F.lpad(F.conv(F.substring(sha, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)])
    return F.translate(F.upper(digits), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def surt(url: Column) -> Column:
    """URL key: host labels reversed, without scheme, port, user, www and fragment, in lower case."""
    rest = F.regexp_replace(F.lower(F.coalesce(url, F.lit(""))), r"^[a-z][a-z0-9+.-]*://|#.*$", "")
    host = F.regexp_replace(F.regexp_extract(rest, r"^([^/?]*)", 1), r"^.*@|:[0-9]*$|^www[0-9]*\.", "")
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), F.regexp_extract(rest, r"^[^/?]*(.*)$", 1))


def with_revisits(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """pages(page_id, url, html, captured_at) plus payload, payload_digest, record_type and refers_to.

    Of equal payloads of at least least_bytes bytes, the one with the smallest page_id is the response and the
    others revisit it; a null page_id comes after all others. A null html is an empty payload. Repeated rows with
    the smallest page_id are all responses. Only ids and digests are shuffled; partial sums meet hot payloads."""
    rows = pages.withColumn("payload", F.coalesce(F.col("html"), F.lit(""))).withColumn("payload_digest", base32_sha1(F.col("payload")))
    groups = (
        rows.filter(F.octet_length("payload") >= least_bytes).select("page_id", "payload_digest").groupBy("payload_digest")
        .agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n")).filter("n > 1 and first_id is not null").drop("n")
    )
    # Written first: Spark then knows its size, and broadcasts it only if that is small.
    groups = common.stash(groups, "payload-groups")
    rows = rows.join(groups, "payload_digest", "left")
    again = (F.col("page_id").isNull() | (F.col("page_id") > F.col("first_id"))) & (F.octet_length("payload") >= least_bytes) & F.col("first_id").isNotNull()
    return rows.withColumn("record_type", F.when(again, "revisit").otherwise("response")).withColumn("refers_to", F.when(again, F.col("first_id"))).drop("first_id")


def _hex_length(c: Column) -> Column:
    return F.lower(F.hex(F.octet_length(c).cast("long")))


def _chunked(payload: Column, digest: Column) -> Column:
    parts = F.split(payload, VERSION.replace(".", r"\."), -1)
    n = F.size(parts)

    def chunk(x: Column, i: Column) -> Column:
        body = F.concat(F.when(i > 0, TAIL).otherwise(""), x, F.when(i < n - 1, HEAD).otherwise(""))
        return F.concat(_hex_length(body), F.lit(";d="), digest, F.lit(CRLF), body, F.lit(CRLF))

    return F.concat(F.array_join(F.transform(parts, chunk), ""), F.lit("0" + CRLF + CRLF))


def records(rows: DataFrame) -> DataFrame:
    """One column, value: the WARC record of each row of with_revisits, without its closing CRLF CRLF."""
    revisit, odd = F.col("record_type") == "revisit", F.col("payload").contains(VERSION)
    http = F.concat(
        F.lit("HTTP/1.1 200 OK" + CRLF + "Content-Type: text/html; charset=utf-8" + CRLF),
        F.when(odd & ~revisit, "Transfer-Encoding: chunked" + CRLF).otherwise(F.concat(F.lit("Content-Length: "), F.octet_length("payload"), F.lit(CRLF))),
        F.lit(CRLF),
        F.when(revisit, "").when(odd, _chunked(F.col("payload"), F.col("payload_digest"))).otherwise(F.col("payload")),
    )
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("none")), F.lit(">"))
    line = lambda key, c: F.concat(F.lit(key + ": "), c, F.lit(CRLF))
    uri = F.regexp_replace(F.coalesce(F.col("url"), F.lit("")), r"[\x00-\x20\x7f]", "%20")
    rows = rows.withColumn("block", http)
    value = F.concat(
        F.lit(VERSION + CRLF), line("WARC-Type", F.col("record_type")), line("WARC-Record-ID", name(F.col("page_id"))),
        line("WARC-Date", F.date_format("captured_at", "yyyy-MM-dd'T'HH:mm:ss'Z'")), line("WARC-Target-URI", uri),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        F.when(revisit, F.concat(line("WARC-Refers-To", name(F.col("refers_to"))), F.lit("WARC-Profile: " + PROFILE + CRLF))).otherwise(""),
        line("Content-Type", F.lit("application/http; msgtype=response")), line("Content-Length", F.octet_length("block").cast("string")), F.lit(CRLF), F.col("block"),
    )
    return rows.select(value.alias("value"))


def write_archives(pages: DataFrame, path: str, compression: str = "none") -> None:
    """Write one WARC part per task below path. compression: none or gzip (a part is then one gzip member)."""
    records(with_revisits(pages)).write.option("lineSep", CRLF + CRLF).option("compression", compression).text(path)


def _dechunk(body: Column, digest: Column) -> Column:
    mark = F.concat(F.lit("[0-9a-f]+;d="), digest, F.lit("\r\n"))
    inner = F.regexp_replace(body, F.concat(F.lit("^"), mark, F.lit("|\r\n0\r\n\r\n$")), F.lit(""))
    return F.regexp_replace(inner, F.concat(F.lit("\r\n"), mark), F.lit(""))


def read_archives(spark, path: str) -> DataFrame:
    """The records of all parts: page_id, url, captured_at, record_type, refers_to, payload (null for revisits),
    payload_bytes, payload_digest and archive (its part). The digest of a response is computed from what was read."""
    raw = spark.read.option("lineSep", BORDER).text(path).select("value", F.input_file_name().alias("archive"))
    whole = F.regexp_replace("value", r"^WARC/1\.1\r\n", "")
    raw = raw.select("archive", whole.alias("value")).filter(F.length("value") > 0)
    at = F.instr("value", CRLF + CRLF)
    raw = raw.select("archive", F.substring("value", F.lit(1), at + 1).alias("head"), F.substring("value", at + 4, F.length("value")).alias("block"))
    field = lambda key, what="[^\r]*": F.regexp_extract("head", rf"(?:^|\n){key}: ({what})", 1)
    http_at = F.instr("block", CRLF + CRLF)
    raw = raw.withColumn("http", F.substring("block", F.lit(1), http_at + 1)).withColumn("size", field("Content-Length").cast("long"))
    # The last record of a part still has its closing CRLF CRLF.
    closing = (F.octet_length("block") - F.col("size")).cast("int")
    raw = raw.withColumn("body", F.substring("block", http_at + 4, F.length("block") - http_at - 3 - closing))
    raw = raw.withColumn("body", F.when(F.col("http").contains("Transfer-Encoding: chunked"), _dechunk(F.col("body"), field("WARC-Payload-Digest", "sha1:[A-Z2-7]*").substr(6, 32))).otherwise(F.col("body")))
    revisit = field("WARC-Type") == "revisit"
    number = lambda key: F.regexp_extract("head", rf"(?:^|\n){key}: <urn:page:([^>]*)>", 1).try_cast("long")
    return raw.select(
        number("WARC-Record-ID").alias("page_id"),
        field("WARC-Target-URI").alias("url"), F.to_timestamp(field("WARC-Date"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("captured_at"),
        field("WARC-Type").alias("record_type"), F.when(revisit, number("WARC-Refers-To")).alias("refers_to"),
        F.when(~revisit, F.col("body")).alias("payload"),
        F.when(revisit, F.regexp_extract("http", r"Content-Length: ([0-9]+)", 1).cast("long")).otherwise(F.octet_length("body").cast("long")).alias("payload_bytes"),
        F.when(revisit, field("WARC-Payload-Digest", "sha1:[A-Z2-7]*").substr(6, 32)).otherwise(base32_sha1(F.col("body"))).alias("payload_digest"), "archive",
    )


INDEX = "url_key string, captured_at timestamp, page_id long, record_type string, refers_to long, payload_bytes long, payload_digest string"


def capture_runs(captures: DataFrame) -> DataFrame:
    """Index rows of archived records as locally sorted runs of at most RUN_ROWS rows, in a table."""
    rows = captures.select(surt(F.col("url")).alias("url_key"), *[c.split()[0] for c in INDEX.split(", ")[1:]])

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def run():
            table = pa.Table.from_batches(held)
            return table.sort_by([(c, "ascending") for c in ("url_key", "captured_at", "page_id")]).to_batches()

        for b in batches:
            held.append(b)
            n += b.num_rows
            if n >= RUN_ROWS:
                yield from run()
                held, n = [], 0
        if held:
            yield from run()

    return common.stash(common.map_arrow(rows, sort, INDEX), "capture-runs")


class LoserTree:
    """Tournament of k sorted sources: the winner is at hand, each step replays one path of log2(k) matches."""

    def __init__(self, sources: list[Iterator]):
        self.sources = [iter(s) for s in sources]
        self.k = max(1, len(self.sources))
        self.heads = [next(s, None) for s in self.sources] or [None]
        self.losers = [-1] * self.k
        for i in range(self.k):
            self._replay(i)

    def _before(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return y is None or (x is not None and (x, a) <= (y, b))

    def _replay(self, i: int) -> None:
        at = (i + self.k) // 2
        while at > 0:
            if self.losers[at] < 0:
                self.losers[at] = i  # waits for its opponent
                return
            if not self._before(i, self.losers[at]):
                i, self.losers[at] = self.losers[at], i
            at //= 2
        self.losers[0] = i

    def __iter__(self):
        while (top := self.heads[w := self.losers[0]]) is not None:
            yield top
            self.heads[w] = next(self.sources[w], None)
            self._replay(w)


def merge_runs(runs: DataFrame, rows: int | None = None) -> DataFrame:
    """K-way merge of sorted runs into globally ordered capture histories: by url_key, captured_at and page_id.

    Each task gets one key range, about MERGE_ROWS captures (a hot URL is cut by time and id, and rows that are the same
    in all by their number in the runs); its shuffle blocks are slices of sorted runs, which a loser tree merges. Adds range_no and position: their order is the global order."""
    rows = runs.count() if rows is None else rows
    parts = max(1, -(-rows // MERGE_ROWS))
    dealt = runs.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(parts, "url_key", "captured_at", "page_id", "_row").drop("_row")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        slices, last, held = [], None, []
        for b in batches:
            key_of = lambda u, t, p: (u is not None, u or "", t is not None, t.value if hasattr(t, "value") else t or 0, p is not None, p or 0)
            columns = [b.column(c) for c in ("url_key", "captured_at", "page_id")]
            base = len(held)
            held.append(b)
            times = columns[1].cast(pa.int64()).to_pylist()
            for i, key in enumerate(map(key_of, columns[0].to_pylist(), times, columns[2].to_pylist())):
                if last is None or key < last:  # a new run begins
                    slices.append([])
                slices[-1].append((key, base, i))
                last = key
        if not held:
            return
        order = list(LoserTree(slices))
        starts = [0]
        for b in held:
            starts.append(starts[-1] + b.num_rows)
        table = pa.Table.from_batches(held).take(pa.array([starts[b] + i for _, b, i in order]))
        n, part = len(order), TaskContext.get().partitionId()
        table = table.append_column("range_no", pa.array([part] * n, pa.int32())).append_column("position", pa.array(range(n), pa.int64()))
        yield from table.to_batches(max_chunksize=10_000)

    return common.map_arrow(dealt, merge, INDEX + ", range_no int, position long")


def archive_pages(pages: DataFrame, path: str, compression: str = "none") -> DataFrame:
    """Write pages(page_id, url, html, captured_at) as WARC below path, read the archives back, and return their
    merged capture index. Empty tables give empty results; extra columns are ignored; null urls get an empty key."""
    write_archives(pages, path, compression)
    return merge_runs(capture_runs(read_archives(pages.sparkSession, path)))


def op1_warc_index_merge(spark, sf_dir: str) -> DataFrame:
    """Each page's record as the merged index of the archives has it."""
    pages = common.table(spark, sf_dir, "pages").select("page_id", "url", "html", F.timestamp_seconds(F.lit(1_700_000_000) + F.coalesce(F.col("page_id"), F.lit(0))).alias("captured_at"))
    index = archive_pages(pages, common.scratch_path(spark, "warc"))
    return index.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
h AS (SELECT page_id, body, sha1(body) AS hex, min(page_id) OVER (PARTITION BY body) AS first_id FROM p)
SELECT page_id, CAST(strlen(body) AS BIGINT) AS payload_bytes,
  list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(
    (CAST('0x' || substr(hex, 1 + CAST(5 * (i // 4) AS INTEGER), 5) AS BIGINT) >> CAST(5 * (3 - i % 4) AS INTEGER)) & 31 AS INTEGER), 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id > first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id > first_id THEN first_id END AS refers_to
FROM h
"""

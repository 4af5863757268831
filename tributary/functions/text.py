"""Column functions for identities, references, pointers and texts; all of them are built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that count as white space at the end of a line.
BLANKS = " \t\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0                　"
# Fixed value: the mark after which the text of some exported notices begins.
EXPORT_MARK = "=== OSSelot Export ==="
# References embedded in texts, with a prefix for each merge that they have been through.
REF_TOKEN = r"(?:input\d+-)*(?:LicenseRef-[^\s()]+|SPDXRef-[\w-]+(?!\.\w{2,5}))"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c, more: str = "\n\r") -> Column:
    return F.trim(_c(c), F.lit(BLANKS + more))


def norm_checksum(c) -> Column:
    """Hex digits without surrounding blanks, in lower case."""
    return F.lower(strip(c))


def norm_text(c) -> Column:
    """Line ends as LF, no blanks at the end of lines; blank lines stay."""
    lines = F.split(F.replace(F.replace(_c(c), F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n")), "\n", -1)
    return F.array_join(F.transform(lines, lambda x: F.rtrim(x, F.lit(BLANKS))), "\n")


def text_identity(c) -> Column:
    """MD5 of the normalised text."""
    return F.md5(norm_text(c))


def _first_checksum(m: Column, names: tuple[str, ...]) -> Column:
    return F.coalesce(*[norm_checksum(F.element_at(m, F.lit(n))) for n in names])


def checksum_identity(hashes, names: tuple[str, ...] = ("SHA-1", "MD5", "SHA-256")) -> Column:
    """First known checksum of an array of (alg, content); pairs without either are skipped, later ones win; null if none."""
    good = F.filter(_c(hashes), lambda h: h["alg"].isNotNull() & h["content"].isNotNull())
    last = lambda n: F.try_element_at(F.transform(F.filter(good, lambda h: h["alg"] == n), lambda h: h["content"]), F.lit(-1))
    return F.coalesce(*[norm_checksum(last(n)) for n in names])


def checksum_map_identity(checksums, names: tuple[str, ...] = ("SHA1", "MD5", "SHA256")) -> Column:
    """First known checksum of a map of algorithm to digest."""
    m = _c(checksums)
    return F.coalesce(*[norm_checksum(F.try_element_at(m, F.lit(n))) for n in names])


def verified_identity(hashes, names: tuple[str, ...] = ("sha1", "md5", "sha256")) -> Column:
    """First known checksum of an array of (algorithm, hashValue), whatever the algorithm's case."""
    return checksum_identity(F.transform(_c(hashes), lambda h: F.struct(F.lower(h["algorithm"]).alias("alg"), h["hashValue"].alias("content"))), names)


def stanza_identity(expression, globs) -> Column:
    """MD5 of a licence expression and its sorted non-blank file globs."""
    paths = F.array_sort(F.filter(F.transform(_c(globs), lambda x: strip(x)), lambda g: g != ""))
    return F.md5(F.concat(F.coalesce(strip(expression), F.lit("")), F.lit("\0"), F.array_join(paths, "\0")))


def obligation_identity(topic, text, licenses) -> Column:
    """MD5 of topic, text and sorted licences."""
    names = F.array_sort(F.filter(F.transform(_c(licenses), lambda x: strip(x)), lambda g: g != ""))
    return F.md5(F.concat(F.coalesce(_c(topic), F.lit("")), F.lit("||"), F.coalesce(_c(text), F.lit("")), F.lit("||"), F.array_join(names, "|")))


def strip_export_prefix(c) -> Column:
    """What stands after the first export mark, without leading line ends; texts without it as they are."""
    at = F.instr(_c(c), EXPORT_MARK)
    return F.when(at > 0, F.ltrim(F.substring(_c(c), at + len(EXPORT_MARK), F.length(_c(c))), F.lit("\n"))).otherwise(_c(c))


def norm_notice_text(c) -> Column:
    return norm_text(strip_export_prefix(c))


def norm_cdata(c) -> Column:
    """NA as empty, no CDATA marks, normalised lines."""
    bare = F.replace(F.replace(F.coalesce(_c(c), F.lit("")), F.lit("<![CDATA["), F.lit("")), F.lit("]]>"), F.lit(""))
    return F.when(strip(bare) == "NA", "").otherwise(F.rtrim(norm_text(bare), F.lit("\n")))


def strip_hash_prefix(c) -> Column:
    return F.regexp_replace(F.lower(strip(c)), "^(sha1|md5|sha256):", "")


def split_list(c) -> Column:
    """Non-blank lines, trimmed."""
    return F.filter(F.transform(F.split(F.coalesce(_c(c), F.lit("")), "\n", -1), lambda x: strip(x)), lambda x: x != "")


def split_hashes(c) -> Column:
    return F.transform(split_list(c), strip_hash_prefix)


def escape_cdata(c) -> Column:
    return F.concat(F.lit("<![CDATA["), F.replace(_c(c), F.lit("]]>"), F.lit("]]&gt;")), F.lit("]]>"))


def namespaced_ref(ref, input_index) -> Column:
    """A local reference as its input's own: inputN- goes after SPDXRef- (also in an IRI's fragment), else in front."""
    r, mark = _c(ref), F.concat(F.lit("input"), _c(input_index).cast("string"), F.lit("-"))
    bare = F.regexp_replace(F.substring_index(r, "#", -1), "^SPDXRef-", "")
    base = F.substring(r, F.lit(1), F.length(r) - F.length(F.substring_index(r, "#", -1)) - 1)
    plain = F.when(r.rlike("^SPDXRef-."), F.concat(F.lit("SPDXRef-"), mark, F.substring(r, 9, 1 << 30))).otherwise(F.concat(mark, r))
    return F.when(r.contains("#"), F.concat(base, F.lit("#SPDXRef-"), mark, bare)).otherwise(plain)


def embedded_refs(c) -> Column:
    return F.regexp_extract_all(_c(c), F.lit(f"({REF_TOKEN})"), F.lit(1))


def rewrite_embedded(c, mapping) -> Column:
    """Replace whole reference tokens by a map column; a short id never touches a longer one."""
    tokens = embedded_refs(c)
    between = F.split(_c(c), REF_TOKEN, -1)
    moved = F.transform(tokens, lambda t: F.coalesce(F.try_element_at(_c(mapping), t), t))
    pieces = F.zip_with(between, moved, lambda b, t: F.concat(b, F.coalesce(t, F.lit(""))))
    return F.array_join(pieces, "")


def rewrite_iri(c, mapping) -> Column:
    """The mapped value of an IRI, or of its fragment with the base kept."""
    v, m = _c(c), _c(mapping)
    fragment = F.substring_index(v, "#", -1)
    base = F.substring(v, F.lit(1), F.length(v) - F.length(fragment) - 1)
    target = F.try_element_at(m, fragment)
    whole = F.when(target.rlike("^(http|urn:)"), target).otherwise(F.concat(base, F.lit("#"), target))
    return F.coalesce(F.try_element_at(m, v), F.when(v.contains("#"), whole), v)


def display_name(*columns) -> Column:
    """First non-empty of the given columns."""
    return F.coalesce(*[F.nullif(_c(c), F.lit("")) for c in columns], F.lit("unknown"))


def strip_text_tag(c) -> Column:
    return F.when(strip(c).rlike(r"(?s)^<text>.*</text>$"), strip(F.regexp_extract(strip(c), r"(?s)^<text>(.*)</text>$", 1))).otherwise(_c(c))


def pointer_escape(c) -> Column:
    return F.replace(F.replace(_c(c), F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))


def pointer_unescape(c) -> Column:
    return F.replace(F.replace(_c(c), F.lit("~1"), F.lit("/")), F.lit("~0"), F.lit("~"))


def pointer_tokens(c) -> Column:
    """Tokens of a JSON pointer; an empty pointer or / is the root."""
    return F.when(_c(c).isin("", "/"), F.array().cast("array<string>")).otherwise(F.transform(F.split(F.substring(_c(c), 2, 1 << 30), "/", -1), pointer_unescape))


def split_identity_path(c) -> Column:
    """/kind/identity/field as a struct; field may hold slashes or be null."""
    parts = F.split(_c(c), "/", 4)
    get = lambda i: F.nullif(F.get(parts, F.lit(i)), F.lit(""))
    return F.struct(get(1).alias("kind"), get(2).alias("identity_key"), get(3).alias("field"))


def count_matches(text, term) -> Column:
    """How often term is in text, whatever the case, without overlaps; 0 for an empty term."""
    t, q = F.lower(F.coalesce(_c(text), F.lit(""))), F.lower(_c(term))
    return F.when(F.length(q) > 0, ((F.length(t) - F.length(F.replace(t, q, F.lit("")))) / F.greatest(F.length(q), F.lit(1))).cast("int")).otherwise(0)


def preview(c, n: int = 120) -> Column:
    return F.when(F.length(_c(c)) > n, F.concat(F.left(_c(c), F.lit(n - 1)), F.lit("…"))).otherwise(_c(c))


def safe_name(c) -> Column:
    return F.trim(F.regexp_replace(_c(c), r"[^A-Za-z0-9_.-]", "_"), F.lit("._"))


def stable_key(c) -> Column:
    """A canonical string of a value: JSON for nested ones (VARIANT sorts its keys), else its text."""
    return F.to_json(F.parse_json(_c(c)))

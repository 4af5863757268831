"""Personal data: high-recall generators propose overlapping spans, gradient-boosted trees judge them by format and
context, and a threshold calibrated for each kind selects what is redacted. Spans of the base rules always stay."""

from __future__ import annotations

import bisect
import hashlib
import ipaddress
import random
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import accumulate, islice, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from tributary.llm import common

BASE_KINDS = ("email", "ip", "card", "phone")
#: What the method may add.
MORE_KINDS = ("email_like", "ip_like", "number", "phone_like", "secret")
#: Made texts that are added to those of a table, of each form of made_texts: a table may have none of some form.
MADE_ROWS = 30
#: Share of what a threshold selects that must be positive on the texts kept back for calibration.
PRECISION = 0.98
#: No threshold is below this.
LEAST_THRESHOLD = 0.1
#: Trees, their rate, and the quantiles at which a feature may be split: those of a table and those of the made texts.
ROUNDS, RATE, SHARES = 40, 0.3, [k / 33 for k in range(1, 33)]
#: Gradients are summed as whole numbers of 1 / UNIT: doubles hold such sums exactly, so partitions do not change them.
UNIT = 2.0**20
#: Thresholds are chosen from so many; trees after which the odds of a table's candidates are kept anew; candidates of a task.
GRID, REFRESH, PART_ROWS = 1000, 10, 50_000

_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_NOT_LOCAL = re.compile(r"[^A-Za-z0-9._%+-]")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]")
_MAYBE = re.compile(r"[0-9@]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of local@domain.domain, leftmost first; found from each @, so long texts take linear time."""
    free = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > free and not _NOT_LOCAL.match(text, start - 1):
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            free = m.end()
        at = text.find("@", max(at + 1, free))


def ips(text: str) -> Iterator[tuple[int, int, bool]]:
    for m in _IP.finditer(text):
        yield m.start(), m.end(), all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split("."))


def cards(text: str) -> Iterator[tuple[int, int, bool]]:
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        yield m.start(), m.end(), 16 <= len(digits) <= 19 and luhn(digits)


def phones(text: str) -> Iterator[tuple[int, int, bool]]:
    for m in _PHONE.finditer(text):
        yield m.start(), m.end(), 8 <= len(_DIGITS.findall(m[0])) <= 15


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by kind as listed and then by start."""
    if not _MAYBE.search(text):
        return []
    out = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    out += [("ip", a, b) for a, b, good in ips(text) if good]
    out += [("card", a, b) for a, b, good in cards(text) if good]
    if "+" in text:
        out += [("phone", a, b) for a, b, good in phones(text) if good]
    return out


_ASKED = r"(?<![A-Za-z])(?:[Pp]assword|[Pp]asswd|pwd|[Pp]assphrase|[Tt]oken|[Ss]ecret|[Kk]ey)[\"']? ?[:=] ?"
#: Where a pattern has a group, the group is the candidate, and a match without it is none.
_PROPOSE = {
    # A run of a local part's signs is read once, whether an address follows or not; not past the end of a sentence.
    "email_like": (re.compile(r"([A-Za-z0-9._%+-]++ ?(?:@|\[at\]|\(at\)| at ) ?[A-Za-z0-9-]{1,63}(?:(?:\.| \. | ?\[dot\] ?| ?\(dot\) ?| dot )[A-Za-z0-9-]{1,63}){1,4})|[A-Za-z0-9._%+-]++"),),
    "ip_like": (re.compile(r"(?<![0-9A-Fa-f:.])(?:[0-9]{1,3}(?:\.[0-9]{1,3}){3}|[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{0,4}){2,7})(?![0-9A-Fa-f:])"),),
    "number": (
        re.compile(r"(?<![0-9])[0-9](?:[ .-]?[0-9]){7,}+"), re.compile(r"(?<![0-9])[0-9]{8,}+"), re.compile(r"(?<![0-9])[0-9]{4}(?:[ -][0-9]{4}){3}(?![0-9])"),
        re.compile(r"(?<![0-9])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9])"), re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?![A-Za-z0-9])"),
    ),
    "phone_like": (re.compile(r"(?<![0-9A-Za-z])(?:\+|00)?[(]?[0-9]{1,4}[)]?(?:[ ./-]{0,2}[(]?[0-9]{1,5}[)]?){2,6}(?![0-9A-Za-z])"),),
    "secret": (
        re.compile(r"(?<![A-Za-z0-9_-])(?=[A-Za-z_-]*+[0-9])[A-Za-z0-9_-]{12,}+"),  # of any length
        re.compile(r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}+(?:\.[A-Za-z0-9_-]{8,}+){2}"),  # a signed token with its signature
        re.compile(rf"{_ASKED}[\"']?([A-Za-z0-9!#$%^&*_+~-]{{8,}}+)"),  # whatever a cue names, letters alone too
    ),
}
_QUICK = re.compile(rf"[0-9@]|\bat\b|\[at\]|\(at\)|{_ASKED}")
#: Fixed words that often stand beside each kind.
_CUES = {
    "email_like": ("mail", "contact", "write", "@"), "ip_like": ("ip", "host", "server", "address"), "number": ("card", "account", "acct", "visa", "iban", "ssn"),
    "phone_like": ("phone", "tel", "call", "fax", "mobile"), "secret": ("token", "key", "secret", "password", "bearer"),
}
#: A cue as a word of its own, with no digit between it and the candidate.
_SAID = {kind: re.compile(r"(?<![a-z])(?:" + "|".join(cues) + r")[^0-9]{0,16}\Z") for kind, cues in _CUES.items()}
_ASKED_BEFORE = re.compile(_ASKED + r"[\"']?\Z")
#: Fixed words that say what else a number or a run of signs may be.
_OTHER = re.compile(r"(?:order|invoice|serial|part|lot|ticket|commit|build|version|rev|sha256|checksum|id|isbn|room|page|ref|model|file)[^0-9a-z]{0,4}\Z")
_ADDRESS = re.compile(r"[A-Za-z0-9._%+-]+(?: ?(@) ?| ?([\[(])at[\])] ?|( at ))[A-Za-z0-9-]+(?:(?:\.| \. | ?[\[(]dot[\])] ?| dot )[A-Za-z0-9-]+)*(?:\.| \. | ?[\[(]dot[\])] ?| dot )[A-Za-z]{2,}")
_SPELLED = re.compile(r"[\[(]dot[\])]| dot ")
_DATE = re.compile(r"(?:19|20)[0-9]{2}[-./ ][0-9]{1,2}[-./ ][0-9]{1,2}.*|[0-9]{1,2}[-./ ][0-9]{1,2}[-./ ](?:19|20)[0-9]{2}.*", re.S)
_AREA = re.compile(r"(?:\+?1[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}")
_KEY_FORM = re.compile(r"A[KS]IA[A-Z0-9]{16}|gh[oprsu]_[A-Za-z0-9]{30,}|github_pat_[A-Za-z0-9_]{30,}|glpat-[A-Za-z0-9_-]{20,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk[-_][A-Za-z0-9_-]{20,}|AIza[A-Za-z0-9_-]{35}|eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+")


def proposals(text: str) -> list[tuple[str, int, int]]:
    """All candidate spans of all generators; they may overlap."""
    if not _QUICK.search(text):
        return []
    return [(kind, a, b) for kind, ps in _PROPOSE.items() for a, b in dict.fromkeys(m.span(p.groups) for p in ps for m in p.finditer(text) if m[p.groups])]


def _iban(s: str) -> bool:
    """Whether s is an account number whose two check digits are right."""
    x = s.replace(" ", "")
    if not re.fullmatch(r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}", x):
        return False
    return int("".join(str(int(c, 36)) for c in x[4:] + x[:4])) % 97 == 1


def _address(s: str) -> bool:
    try:
        ipaddress.ip_address(s)
    except ValueError:
        return False
    return True


def evidence(text: str, kind: str, start: int, end: int) -> list[float]:
    """What speaks for a candidate, whatever the base rules match: its checksum or valid form, a cue word just before
    it, and that it isn't cut out of a longer word."""
    s, before = text[start:end], text[max(0, start - 24) : start].lower()
    only = "".join(_DIGITS.findall(s))
    said = bool(_SAID[kind].search(before))
    whole = not (text[start - 1 : start].isalnum() and start > 0) and not text[end : end + 1].isalnum()
    form = sure = False
    if kind == "email_like" and (m := _ADDRESS.fullmatch(s)):
        form, sure = True, not m[3] or bool(_SPELLED.search(s))
    elif kind == "ip_like":
        form = sure = _address(s)
    elif kind == "number":
        plain = bool(re.fullmatch(r"[0-9 .-]+", s))
        known = len(only) >= 16 or only[:2] in ("34", "37") and len(only) == 15 or only[:2] in ("30", "36", "38") and len(only) == 14
        sure = _iban(s) or (plain and 13 <= len(only) <= 19 and known and luhn(only))
        form = sure or (plain and 8 <= len(only) <= 17)
    elif kind == "phone_like":
        form = 7 <= len(only) <= 15 and not _DATE.fullmatch(s) and not _address(s)
        sure = form and (bool(_AREA.fullmatch(s)) or (s[:1] == "+" and len(only) >= 8))
    elif kind == "secret":
        form, sure = len(set(s)) >= 8, bool(_KEY_FORM.fullmatch(s))
    return [float(form), float(sure), float(said), float(whole)]


def features(text: str, kind: str, start: int, end: int) -> list[float]:
    """Format and context of a candidate; none of them is what a base rule decides by alone."""
    s = text[start:end]
    n = max(1, len(s))
    digits = sum(c.isdigit() for c in s)
    letters = sum(c.isalpha() for c in s)
    before, after = text[max(0, start - 24) : start].lower(), text[end : end + 12].lower()
    numbers = re.findall(r"[0-9]+", s)
    only = "".join(numbers)
    return [
        MORE_KINDS.index(kind), len(s), digits / n, letters / n, sum(c.isupper() for c in s) / n, len(set(s.lower())) / n, len(numbers), max(map(len, numbers), default=0),
        max((int(x[:6]) for x in numbers), default=0), float(luhn(only)) if only else -1, s.count("."), s.count("@"), s.count("-") + s.count(" "), float(s[:1] == "+"), len(only),
        float(re.fullmatch(r"[0-9a-fA-F]+", s) is not None), float(any(c in before for c in _CUES[kind])), float(before.rstrip()[-1:] in ("=", ":", '"', "'")), float(after[:1] in ('"', "'")),
        float(before[-1:].isalnum()), float(after[:1].isalnum()), float("(" in s), s.count(":"), s.count(". "), float(_iban(s)), float(_address(s)), float(_KEY_FORM.fullmatch(s) is not None),
        float(_SAID[kind].search(before) is not None), float(_AREA.fullmatch(s) is not None), float(_DATE.fullmatch(s) is not None), float(_SPELLED.search(s) is not None), float(" at " in s),
        sum(a.isdigit() != b.isdigit() for a, b in pairwise(s)) / n, float(_ASKED_BEFORE.search(text, max(0, start - 24), start) is not None), len(re.findall("[A-Za-z]+", s)),
        float(_OTHER.search(before) is not None), float(s[-1:].isalpha() and s.rpartition(".")[2].islower() and 2 <= len(s.rpartition(".")[2]) <= 4),
    ]


def weak_label(text: str, kind: str, start: int, end: int) -> int:
    """What stands in for annotations in texts of a table: a sure form (a checksum, a valid address, a spelled @, a known kind of key), or
    a possible form with a cue; for secrets a cue and many different signs."""
    form, sure, said, whole = evidence(text, kind, start, end)
    if kind == "secret":
        before = text[max(0, start - 24) : start].lower()
        return int(sure or (form and any(c in before for c in _CUES["secret"])))
    return int(whole and (sure or (form and said)))


def made_texts(each: int = MADE_ROWS) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """Texts with a value of a form each, and the personal data in them (kind, start, end): none for what only looks
    like it; always the same ones. What they are is known from how they were made, not from any rule."""
    rng = random.Random(17)
    word = lambda: "".join(rng.choice(["ra", "ten", "lo", "mi", "sor", "ve", "an", "dul"]) for _ in range(rng.randrange(1, 4)))
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    hexes = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    signs = lambda n: "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(n))
    letters = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    tld = lambda: rng.choice(["org", "com", "net", "de", "io"])
    other = lambda: rng.choice(["order", "invoice", "serial", "part", "lot", "ticket", "model", "page", "about", "total", word(), word()])
    asked = lambda: rng.choice(["password", "passwd", "token", "secret", "api_key", "key"]) + rng.choice(["=", " = ", ": ", '="', ' = "'])

    def checked(n: int, head: str = "") -> str:
        x = head + digits(n - 1 - len(head))
        return next(x + c for c in "0123456789" if luhn(x + c))

    def iban() -> str:
        x = rng.choice(["DE", "FR", "ES", "GB"])
        body = ("".join(rng.choice("ABCDEFGHKLMN") for _ in range(4)) if x == "GB" else "") + digits(18)
        x = next(y for k in range(98) if _iban(y := f"{x}{k:02d}{body}"))
        return x if rng.random() < 0.5 else " ".join(x[i : i + 4] for i in range(0, len(x), 4))

    def v6() -> str:
        parts = [f"{rng.randrange(1, 1 << 16):x}" for _ in range(8)]
        return ":".join(parts) if rng.random() < 0.5 else ":".join(parts[: rng.randrange(2, 5)]) + "::" + parts[7]

    def phone() -> str:
        return rng.choice([f"{digits(3)} {digits(4)} {digits(3)}", f"{digits(3)} {digits(4)} {digits(4)}", f"{digits(3)}-{digits(4)}", f"0{digits(2)}/{digits(7)}", f"0{digits(3)} {digits(6)}", f"{digits(3)} {digits(3)} {digits(3)}"])

    def words_(n: int, joint: str) -> str:
        return joint.join(word() for _ in range(n))

    # kind (None: not personal data), what stands before (a word, or another value with its kind), the value
    forms = [
        lambda: ("email_like", "", f"{word()} [at] {word()} (dot) {tld()}"), lambda: ("email_like", "", f"{word()}(at){word()}[dot]{tld()}"), lambda: ("email_like", "", f"{word()} at {word()} dot {tld()}"),
        lambda: ("email_like", rng.choice(["mail ", "contact ", "write "]), f"{word()} at {word()}.{tld()}"), lambda: ("email_like", "", f"{word()}.{word()} @ {word()}.{tld()}"),
        lambda: (None, "", f"{word()} at {word()}. {word().capitalize()}"), lambda: (None, "", f"{word()} at {word()}.{word()}"), lambda: (None, "", f"{word()} at {word()} . {word()}"),
        lambda: ("ip_like", "", v6()), lambda: ("ip_like", rng.choice(["host ", "server ", "ip "]), v6()), lambda: (None, "", f"{rng.randrange(24):02d}:{digits(2)}:{digits(2)}"), lambda: (None, "", ":".join(hexes(2) for _ in range(6))),
        lambda: (None, "", f"{rng.randrange(300, 999)}.{digits(2)}.{digits(1)}.{digits(2)}"), lambda: (None, "", f"{rng.randrange(1, 9)}:{rng.randrange(1, 9)}:{rng.randrange(1, 99)}"),
        lambda: ("number", "", iban()), lambda: ("number", rng.choice(["iban ", "account ", "to "]), iban()), lambda: ("number", "", checked(15, rng.choice(["34", "37"]))), lambda: ("number", rng.choice(["card ", "visa ", "card no. "]), checked(15, rng.choice(["34", "37"]))),
        lambda: ("number", ("phone_like", f"+1 ({digits(3)}) {digits(3)}-{digits(4)}"), checked(16, "4")), lambda: ("number", rng.choice(["account ", "acct ", "account number: ", "account no. "]), digits(rng.randrange(8, 13))),
        lambda: ("number", rng.choice(["ssn ", "ssn: ", "ssn is "]), f"{digits(3)}-{digits(2)}-{digits(4)}"),
        lambda: (None, "", digits(rng.randrange(8, 20))), lambda: (None, f"{other()} ", digits(rng.randrange(8, 14))), lambda: (None, f"{other()} ", f"{digits(3)}-{digits(2)}-{digits(4)}"), lambda: (None, f"{other()} ", "-".join(digits(4) for _ in range(3))),
        lambda: (None, f"{other()} ", digits(16)), lambda: (None, f"{other()} ", f"{rng.choice('ABCD')}{rng.choice('EFGH')}{digits(rng.randrange(13, 20))}"), lambda: (None, "isbn ", f"978{digits(10)}"),
        lambda: ("phone_like", rng.choice(["phone ", "call ", "tel: ", "tel. ", "fax ", "mobile ", "mobile: "]), phone()), lambda: ("phone_like", rng.choice(["phone ", "call ", "tel: "]), phone()), lambda: ("phone_like", rng.choice(["", "", "phone "]), f"({digits(3)}) {digits(3)}-{digits(4)}"), lambda: ("phone_like", rng.choice(["", "", "call "]), f"{digits(3)}-{digits(3)}-{digits(4)}"),
        lambda: ("phone_like", "", f"({digits(3)}) {digits(3)}-{digits(4)}"),
        lambda: (None, "", f"{rng.randrange(1950, 2030)}-{rng.randrange(1, 13):02d}-{rng.randrange(1, 29):02d}"), lambda: (None, f"{other()} ", f"{digits(3)} {digits(3)} {digits(2)}"), lambda: (None, "", f"{digits(2)}.{digits(3)}.{digits(3)}"), lambda: (None, f"{other()} ", f"{digits(2)}-{digits(2)}-{digits(2)}"),
        lambda: (None, f"{other()} ", phone()), lambda: (None, "", f"{digits(2)} {digits(2)} {digits(2)} {digits(2)}"), lambda: (None, f"{other()} ", f"{digits(1)}.{digits(2)}.{digits(2)}.{digits(4)}"),
        lambda: ("secret", asked(), hexes(rng.randrange(12, 900))), lambda: ("secret", asked(), signs(rng.randrange(12, 60)) + "7a"), lambda: ("secret", asked(), letters(rng.randrange(12, 30))), lambda: ("secret", "bearer ", f"eyJ{hexes(rng.randrange(20, 60))}.{hexes(rng.randrange(40, 400))}.{hexes(342)}"),
        lambda: ("secret", "", f"eyJ{hexes(rng.randrange(20, 60))}.{hexes(rng.randrange(40, 400))}.{hexes(342)}"), lambda: ("secret", "", "AKIA" + "".join(rng.choice("ABCDEFGHJKLMNPQRSTUVWXYZ234567") for _ in range(16))), lambda: ("secret", "", "ghp_" + signs(36)), lambda: ("secret", rng.choice(["", "bearer "]), "sk-" + signs(40) + "3b"),
        lambda: (None, "commit ", hexes(40)), lambda: (None, rng.choice(["", "id "]), f"{hexes(8)}-{hexes(4)}-{hexes(4)}-{hexes(4)}-{hexes(12)}"), lambda: (None, rng.choice(["sha256 ", "checksum ", "rev ", ""]), hexes(rng.choice([16, 32, 64]))), lambda: (None, "", f"{words_(3, '-')}-{rng.randrange(1990, 2030)}"),
        lambda: (None, "", f"{words_(3, '_').upper()}_{digits(2)}"), lambda: (None, "file ", f"IMG_{digits(8)}_{digits(6)}"), lambda: (None, asked(), rng.choice(["required", "mandatory", "undefined", "placeholder", "something", "description"])), lambda: (None, "", "".join(word().capitalize() for _ in range(4)) + digits(1)),
    ]
    side = lambda: " ".join(word() for _ in range(rng.randrange(1, 6)))
    out = []
    for _ in range(each):
        for form in forms:
            kind, before, value = form()
            head, truth = f"{side()} ", []
            if isinstance(before, tuple):
                truth.append((before[0], len(head), len(head) + len(before[1])))
                before = before[1] + " "
            head += before
            if kind:
                truth.append((kind, len(head), len(head) + len(value)))
            tail = rng.choice(["", ".", ","]) if not before.endswith('"') else '"'
            out.append((f"{head}{value}{tail} {side()}", truth))
    return out


@dataclass
class Trees:
    """Boosted trees of depth 3 on the log-odds; each is its features, borders and leaf values."""

    start: float = 0.0
    trees: list = field(default_factory=list)
    thresholds: dict = field(default_factory=dict)

    def odds(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        for axis, border, leaf in self.trees:
            out += leaf[_leaves(x, axis, border)]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.odds(x)))


def _leaves(x: np.ndarray, axis: np.ndarray, border: np.ndarray, levels: int = 3) -> np.ndarray:
    """The node of a level, from its left, that each row comes to."""
    node, rows = np.zeros(len(x), dtype=np.int64), np.arange(len(x))
    for _ in range(levels):
        node = 2 * node + 1 + (x[rows, axis[node]] > border[node])
    return node - (2**levels - 1)


# Candidates for fitting are rows of small numbers: kind, label, whether kept back for calibration, and the features' bins.
_BINS = 3


def _coded(x: np.ndarray, y: np.ndarray, held: np.ndarray, borders: list[np.ndarray]) -> np.ndarray:
    return np.stack([x[:, 0], y, held, *(np.searchsorted(b, x[:, k], "left") for k, b in enumerate(borders))], axis=1).astype(np.uint8)


def _quantiles(x: np.ndarray) -> np.ndarray:
    """SHARES of each column, by the rule of Spark's percentile."""
    x, at = np.sort(x, axis=0), (len(x) - 1) * np.array(SHARES)
    low, high = np.floor(at), np.ceil(at)
    a, b = x[low.astype(int)], x[high.astype(int)]
    return np.where(a == b, a, (high - at)[:, None] * a + (at - low)[:, None] * b).T


def _later(rows: np.ndarray, odds: np.ndarray, trees: list) -> np.ndarray:
    for axis, cut, leaf in trees:
        odds = odds + leaf[_leaves(rows[:, _BINS:], axis, cut)]
    return odds


def _sums(rows: np.ndarray, odds: np.ndarray, tree: tuple, level: int, width: int) -> np.ndarray:
    """First and second derivatives of the rows that are fitted on, by feature, node of the level and bin."""
    p = 1 / (1 + np.exp(-odds))
    fitted = rows[:, 2] == 0
    gh = [np.rint(v * UNIT) * fitted for v in (rows[:, 1] - p, p * (1 - p) + 1e-6)]
    node = _leaves(rows[:, _BINS:], *tree, level) * width
    bins = [node + rows[:, k] for k in range(_BINS, rows.shape[1])]
    return np.array([[np.bincount(b, v, width << level).reshape(-1, width) for b in bins] for v in gh])


def _tally(rows: np.ndarray, odds: np.ndarray) -> np.ndarray:
    """Of the rows kept back, all and positive ones by kind and probability."""
    held = rows[:, 2] == 1
    at = rows[held, 0].astype(np.int64) * (GRID + 1) + np.floor(GRID / (1 + np.exp(-odds[held]))).astype(np.int64)
    return np.array([np.bincount(at, v, len(MORE_KINDS) * (GRID + 1)) for v in (np.ones(held.sum()), rows[held, 1])]).reshape(2, len(MORE_KINDS), GRID + 1)


class _Here:
    """Candidates in this process."""

    def __init__(self, rows: np.ndarray, start: float):
        self.rows, self.odds = rows, np.full(len(rows), start)

    def add(self, tree: tuple) -> None:
        self.odds = _later(self.rows, self.odds, [tree])

    def total(self, function, *args) -> np.ndarray:
        return function(self.rows, self.odds, *args)

    def free(self) -> None:
        pass


class _There:
    """Candidates of a table in an RDD of blocks; each pass over them is a job whose tasks return sums alone."""

    def __init__(self, blocks, start: float):
        self.blocks, self.start, self.trees, self.since = blocks, start, [], []
        self._keep()

    def _keep(self) -> None:
        trees, start = self.trees, self.start
        self.rated = self.blocks.map(lambda rows: (rows, _later(rows, np.full(len(rows), start), trees))).persist()

    def add(self, tree: tuple) -> None:
        self.since.append(tree)
        if len(self.since) == REFRESH:
            self.trees, self.since = self.trees + self.since, []
            self.rated.unpersist()
            self._keep()

    def total(self, function, *args) -> np.ndarray:
        since = self.since

        def part(blocks):
            out = None
            for rows, odds in blocks:
                one = function(rows, _later(rows, odds, since), *args)
                out = one if out is None else out + one
            return [] if out is None else [out]

        return sum(self.rated.mapPartitions(part).collect())

    def free(self) -> None:
        self.rated.unpersist()
        self.blocks.unpersist()


def boost(parts: list, borders: list[np.ndarray]) -> tuple[list, list]:
    """Second-order boosting over (candidates, weight): each split takes the border that gains most, by the derivatives of
    all candidates. Trees by bins and by borders."""
    width = max(map(len, borders)) + 1
    inside = np.arange(width - 1) < np.array([[len(b)] for b in borders])
    by_bin, by_border = [], []
    for _ in range(ROUNDS):
        axis, cut, border = np.zeros(7, dtype=np.int64), np.full(7, 255), np.full(7, np.inf)
        leaf = np.zeros(8)
        for level in range(3):
            totals = sum(w * c.total(_sums, (axis, cut), level, width) for c, w in parts) / UNIT
            for j in range(2**level):
                gs, hs = np.cumsum(totals[:, :, j], axis=2)
                g, h = gs[0, -1], hs[0, -1]
                gain = gs**2 / (hs + 1) + (g - gs) ** 2 / (h - hs + 1) - g**2 / (h + 1)
                gain = np.where(inside, gain[:, :-1], 0)
                k, at = divmod(int(gain.argmax()), width - 1)
                left = (g, h)
                if gain[k, at] > 1e-6:
                    top = 2**level - 1 + j
                    axis[top], cut[top], border[top] = k, at, borders[k][at]
                    left = (gs[k, at], hs[k, at])
                if level == 2:
                    leaf[2 * j : 2 * j + 2] = RATE * left[0] / (left[1] + 1), RATE * (g - left[0]) / (h - left[1] + 1)
        by_bin.append((axis, cut, leaf))
        by_border.append((axis, border, leaf))
        for c, _ in parts:
            c.add(by_bin[-1])
    return by_bin, by_border


def _free_of(base: list[tuple[str, int, int]]):
    """Whether a span overlaps none of base."""
    at = sorted((a, b) for _, a, b in base)
    starts, ends = [a for a, _ in at], list(accumulate((b for _, b in at), max))
    return lambda a, b: not (k := bisect.bisect_left(starts, b)) or ends[k - 1] <= a


def _judged(text: str, base: list, found: list, truth: list | None = None) -> Iterator[tuple[list[float], int]]:
    """Features and label of candidates. What overlaps a base span stays out: it can't be added."""
    free = _free_of(base)
    for kind, a, b in found:
        if free(a, b):
            yield features(text, kind, a, b), weak_label(text, kind, a, b) if truth is None else int((kind, a, b) in truth)


def _held(text: str) -> bool:
    """Whether a text of a table is kept back for calibration: a third of them are, and copies together."""
    return zlib.crc32(text.encode("utf-8", "surrogatepass")) % 3 == 2


def _arrays(rows: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    x, y, held = zip(*rows, strict=True) if rows else ((), (), ())
    return np.array(x, dtype=np.float64), np.array(y), np.array(held)


def _learn(table: tuple, made: list[tuple[str, list[tuple[str, int, int]]]], part) -> Trees:
    """Trees from a table's candidates and those of made texts, and for each kind the least threshold at which PRECISION of
    what is selected of those kept back is positive (none selected if there is no such).

    table: how many candidates, how many to fit on, how many of these are positive, quantiles of these; part(borders, start)
    gives them. A table's candidates count one each until they are as many as those of made texts; more of them share that
    weight, so that the forms that only made texts have are not forgotten on large tables."""
    n, n_fit, positive, quantiles = table
    x, y, held = _arrays([(f, label, i % 3 == 2) for i, (text, truth) in enumerate(made) for f, label in _judged(text, base_spans(text), proposals(text), truth)])
    weight = min(1.0, len(y) / n) if len(y) and n else 1.0
    model = Trees()
    total = weight * n_fit + (held == 0).sum()
    if not total:
        model.thresholds = dict.fromkeys(MORE_KINDS, 1.1)
        return model
    p = min(0.99, max(0.01, (weight * positive + (y[held == 0].sum() if len(y) else 0)) / total))
    model.start = float(np.log(p / (1 - p)))
    known = [q for q in (quantiles if n_fit else None, _quantiles(x[held == 0]) if (held == 0).any() else None) if q is not None]
    borders = [np.unique(np.concatenate(q)) for q in zip(*known, strict=True)]
    parts = ([(part(borders, model.start), weight)] if n else []) + ([(_Here(_coded(x, y, held, borders), model.start), 1.0)] if len(y) else [])
    _, model.trees = boost(parts, borders)
    every, right = np.cumsum(sum(w * c.total(_tally) for c, w in parts)[:, :, ::-1], axis=2)
    for c, _ in parts:
        c.free()
    for number, kind in enumerate(MORE_KINDS):
        good = np.flatnonzero((every[number] > 0) & (right[number] >= PRECISION * every[number]))
        model.thresholds[kind] = max(LEAST_THRESHOLD, (GRID - int(good[-1])) / GRID) if len(good) else 1.1
    return model


def fit(texts: list[str], made: list[tuple[str, list[tuple[str, int, int]]]] = ()) -> Trees:
    """As learn, from a few texts in this process."""
    x, y, held = _arrays([(f, label, _held(text)) for text in texts for f, label in _judged(text, base_spans(text), proposals(text))])
    used = held == 0
    table = (len(y), int(used.sum()), int(y[used].sum()) if len(y) else 0, _quantiles(x[used]) if used.any() else None)
    return _learn(table, made, lambda borders, start: _Here(_coded(x, y, held, borders), start))


_SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
_SPANS = "array<struct<kind:string,start:long,end:long>>"
#: Columns that scan adds.
SEEN = ("base spans", "candidate spans")


def _pa_spans(spans: list) -> pa.Array:
    return pa.array([[dict(zip(("kind", "start", "end"), s, strict=True)) for s in ss] for ss in spans], _SPAN)


def _tuples(column: pa.Array) -> Iterator[list[tuple[str, int, int]]]:
    for spans in column:
        yield [(s["kind"], s["start"], s["end"]) for s in spans.as_py()]


def scan(docs: DataFrame) -> DataFrame:
    """docs with the base spans and the candidates of column text; all columns and rows stay."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, _pa_spans([base_spans(t) for t in texts]), _pa_spans([proposals(t) for t in texts])], [*batch.schema.names, *SEEN])

    kind = ArrayType(StructType([StructField("kind", StringType()), StructField("start", LongType()), StructField("end", LongType())]))
    return common.map_arrow(docs, run, StructType([*docs.schema.fields, *(StructField(c, kind) for c in SEEN)]))


def candidates(seen: DataFrame) -> DataFrame:
    """Features x, label y and whether kept back, of every candidate of scanned documents that can be added."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                for text, base, found in zip(batch.column(0), _tuples(batch.column(1)), _tuples(batch.column(2)), strict=True):
                    text = text.as_py()
                    held = _held(text)
                    for f, label in _judged(text, base, found):
                        yield f, label, held

        every = rows()
        while some := list(islice(every, 10_000)):
            x, y, held = zip(*some, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), pa.array(y, pa.int32()), pa.array(held, pa.bool_())], ["x", "y", "held"])

    return common.map_arrow(seen.filter(F.size(SEEN[1]) > 0).select("text", *SEEN), run, "x array<double>, y int, held boolean")


def learn(seen: DataFrame) -> Trees:
    """Trees and thresholds from every candidate of every scanned document, with weak labels, and from made_texts.

    Candidates are written once; quantiles, the derivatives of each level of each tree and the counts for thresholds are
    sums over all of them, and only these sums come to the driver. They are exact, so the model depends on what the table
    holds alone, not on its order or its partitions."""
    table = common.stash(candidates(seen), "pii-candidates")
    used = ~F.col("held")
    n_features = len(features("1", "number", 0, 1))
    quantiles = [F.percentile(F.when(used, F.get("x", F.lit(k))), SHARES) for k in range(n_features)]
    n, n_fit, positive, *q = table.agg(F.count(F.lit(1)), F.count_if(used), F.sum(F.when(used, F.col("y"))), *quantiles).first()

    def part(borders: list[np.ndarray], start: float) -> _There:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = batch.column(0).flatten().to_numpy().reshape(-1, n_features)
                rows = _coded(x, batch.column(1).to_numpy(), batch.column(2).to_numpy(zero_copy_only=False), borders)
                yield pa.RecordBatch.from_arrays([pa.array([rows.tobytes()], pa.binary())], ["rows"])

        blocks = common.map_arrow(table, run, "rows binary").rdd.map(lambda r: np.frombuffer(r[0], dtype=np.uint8).reshape(-1, _BINS + n_features))
        return _There(blocks.coalesce(n // PART_ROWS + 1).persist(), start)

    return _learn((n, n_fit, positive or 0, np.array(q) if n_fit else None), made_texts(), part)


def _spans_only(docs: DataFrame) -> DataFrame:
    """Scanned documents, written; of texts only those that have candidates."""
    seen = scan(docs)
    return common.stash(seen.withColumn("text", F.when(F.size(SEEN[1]) > 0, F.col("text"))), "pii-seen")


def train(docs: DataFrame) -> Trees:
    """As learn, from docs(text)."""
    return learn(_spans_only(docs.select(F.col("text").cast("string").alias("text"))))


def all_spans(text: str, model: Trees) -> list[tuple[str, int, int]]:
    """Base spans, and of the others those whose probability reaches their kind's threshold: the likely ones first,
    none that overlaps a chosen one. By kind as listed, then start."""
    return choose(text, base_spans(text), proposals(text), model)


def choose(text: str, base: list[tuple[str, int, int]], found: list[tuple[str, int, int]], model: Trees) -> list[tuple[str, int, int]]:
    if not found:
        return base
    p = model.probability(np.array([features(text, *c) for c in found], dtype=np.float64))
    taken = sorted((a, b) for _, a, b in base)
    added = []
    for i in np.argsort(-p, kind="stable"):
        kind, a, b = found[i]
        if p[i] >= model.thresholds.get(kind, 1.1) and all(b <= x or y <= a for x, y in taken):
            taken.append((a, b))
            added.append((kind, a, b))
    order = BASE_KINDS + MORE_KINDS
    return base + sorted(added, key=lambda s: (order.index(s[0]), s[1]))


def chosen(seen: DataFrame, model: Trees) -> DataFrame:
    """doc_id, text and spans (kind, start, end in code points) of scanned documents."""
    shared = seen.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [choose(t or "", b, f, shared.value) for t, b, f in zip(batch.column(1).to_pylist(), _tuples(batch.column(2)), _tuples(batch.column(3)), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], _pa_spans(spans)], ["doc_id", "text", "spans"])

    return common.map_arrow(seen.select("doc_id", "text", *SEEN), run, f"doc_id long, text string, spans {_SPANS}")


def find(docs: DataFrame, model: Trees) -> DataFrame:
    """doc_id, text and spans of docs(doc_id, text). A null text has no spans and stays null; repeated rows are kept;
    extra columns are ignored."""
    return chosen(scan(common.documents(docs)), model)


def redact_text(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span, or run of overlapping spans, as <KIND> of its first."""
    out, last = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= last:
            out += [text[last:a], f"<{kind.upper()}>"]
        last = max(last, b)
    return "".join(out) + text[last:]


def redact(docs: DataFrame, model: Trees) -> DataFrame:
    """docs with the spans in column text redacted; all columns and rows stay, null texts are null."""
    return redact_seen(scan(docs), model)


def redact_seen(seen: DataFrame, model: Trees) -> DataFrame:
    """As redact, of scanned documents."""
    shared, columns = seen.sparkSession.sparkContext.broadcast(model), seen.columns[: -len(SEEN)]
    at = columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            *own, base, found = batch.columns
            texts = [t if t is None else redact_text(t, s) if (s := choose(t, b, f, shared.value)) else t for t, b, f in zip(own[at].to_pylist(), _tuples(base), _tuples(found), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if i == at else c for i, c in enumerate(own)], columns)

    return common.map_arrow(seen, run, StructType(seen.schema.fields[: -len(SEEN)]))


def op8_pii(spark, sf_dir: str) -> DataFrame:
    """Spans of every document."""
    seen = _spans_only(common.documents(common.table(spark, sf_dir, "documents")))
    found = chosen(seen, learn(seen))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))
    return found.select("doc_id", *[count(k) for k in BASE_KINDS], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"))


def brute_force(text: str) -> str:
    """base_sha256 by the rules' own patterns; for tests."""
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 16 <= len(d) <= 19 and luhn(d):
            out.append(("card", m.start(), m.end()))
    out += [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(re.findall("[0-9]", m[0])) <= 15]
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in out).encode()).hexdigest()

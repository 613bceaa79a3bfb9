"""Personal data by anchor expansion.

An Aho-Corasick automaton passes over each text once and finds anchors: at-signs, `://`, colons, plus signs, digits,
identifier cues ("iban", "token", ...) and beginnings that mark a key without any cue ("-----BEGIN", "eyJ", "AKIA", ...).
From each anchor a local parser expands to the left and right, validates what it finds and fixes the boundaries. Cues are
found whatever the case of their ASCII letters. Parsers never rescan: the work is linear in the text.

Nothing is cut by its length: secrets, and users, passwords, hosts and paths of URLs, are read to their ends. What makes a
find is bounded: a secret has 8 characters or more and its sign (: or =) at most 4 spaces on either side; between an account
cue and its number are at most 4 separators; an account number or IBAN has at most 34 characters without separators but
for a number's first letters (up to 4).
"""

from __future__ import annotations

import ipaddress
import re

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

#: Kinds in their order for spans that start together. The first four are the base kinds.
KINDS = ("email", "ip", "card", "phone", "iban", "account", "secret", "url", "ipv6")
BASE_KINDS = KINDS[:4]

#: Words that announce an account or identity number, and words that announce a secret.
ACCOUNT_CUES = ("account", "acct", "iban", "passport", "ssn", "social security", "konto", "cuenta", "compte")
SECRET_CUES = ("password", "passwd", "secret", "token", "api_key", "apikey", "api key", "access_key")
#: How keys begin that need no cue, and how they go on: fixed values.
KEYS = (
    ("AKIA", "[0-9A-Z]{16}"),
    ("ASIA", "[0-9A-Z]{16}"),
    ("AIza", "[0-9A-Za-z_-]{35}"),
    ("ghp_", "[0-9A-Za-z]{36}"),
    ("gho_", "[0-9A-Za-z]{36}"),
    ("ghs_", "[0-9A-Za-z]{36}"),
    ("github_pat_", "[0-9A-Za-z_]{22,}+"),
    ("glpat-", "[0-9A-Za-z_-]{20,}+"),
    ("sk-", "[0-9A-Za-z_-]{20,}+"),
    ("sk_live_", "[0-9A-Za-z]{16,}+"),
    ("xoxb-", "[0-9A-Za-z-]{20,}+"),
    ("xoxp-", "[0-9A-Za-z-]{20,}+"),
    ("eyJ", r"[0-9A-Za-z_-]{8,}+\.[0-9A-Za-z_-]{8,}+\.[0-9A-Za-z_-]*+"),
)
#: A block of a private key, from its first line to its last.
BLOCK_BEGIN, BLOCK_END = "-----BEGIN ", "-----END "

SPAN = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def luhn(digits: str) -> bool:
    """The check-digit rule of payment cards."""
    total = 0
    for k, d in enumerate(reversed(digits)):
        v = ord(d) - 48
        total += v if k % 2 == 0 else v * 2 - 9 * (v > 4)
    return total % 10 == 0


def iban_valid(code: str) -> bool:
    """The mod-97 rule of international account numbers."""
    turned = code[4:] + code[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


HEX = frozenset("0123456789abcdefABCDEF")


def is_ipv6(text: str, start: int, end: int) -> bool:
    """Whether text[start:end], a whole run of hexadecimal digits and colons that no letter or digit touches, is an IPv6 address of at least three groups."""
    if end - start > 39 or text[start - 1 : start].isalnum() or text[end : end + 1].isalnum():
        return False
    run = text[start:end]
    if sum(map(bool, run.split(":"))) < 3:
        return False
    try:
        ipaddress.IPv6Address(run)
    except ValueError:
        return False
    return True


class Finder:
    """The automaton and the parsers; one for each task."""

    def __init__(self):
        import ahocorasick

        self.anchors = ahocorasick.Automaton()
        for d in "0123456789":
            self.anchors.add_word(d, ("d", 1))
        for word, kind in (("@", "@"), ("+", "+"), ("://", "/")):
            self.anchors.add_word(word, (kind, len(word)))
        for cues, kind in ((ACCOUNT_CUES, "a"), (SECRET_CUES, "s")):
            for cue in cues:
                self.anchors.add_word(cue, (kind, len(cue)))
        self.anchors.add_word(":", (":", 1))
        self.anchors.add_word(BLOCK_BEGIN.lower(), ("b", len(BLOCK_BEGIN)))
        for head, _ in KEYS:
            self.anchors.add_word(head.lower(), ("k", len(head)))
        self.anchors.make_automaton()
        self.keys = {head: re.compile(f"{head}{rest}(?![0-9A-Za-z_])").match for head, rest in KEYS}
        self.block = re.compile("-----BEGIN [A-Z0-9 ]*PRIVATE KEY[A-Z0-9 ]*-----").match
        self.block_end = re.compile("-----END [A-Z0-9 ]*-----").search
        self.groups = re.compile("[0-9A-Fa-f:]++").match
        self.local = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
        self.domain = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++").match
        self.address = re.compile(r"[0-9]++(?:\.[0-9]++){3}").match
        self.run = re.compile(r"[0-9]++").match
        self.chain = re.compile(r"[0-9](?:[ -]?[0-9])++").match
        self.phone = re.compile(r"\+[0-9][ ().0-9-]+[0-9]").match
        self.iban = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])").match
        self.number = re.compile(r"(?i:\s*(?:number|no\.?|nr\.?|id))?[\s:#=]{1,4}([A-Z]{0,4}[0-9](?:[ -]?[0-9A-Z]){4,33})(?![A-Za-z0-9])").match
        # the classes around each possessive run don't meet; an unquoted value and a path are read on by `bare` and `path`
        self.value = re.compile(r"\s{0,4}[:=]\s{0,4}(?:\"([^\"\s]{8,}+)\"|'([^'\s]{8,}+)'|(?=[^\s\"']{8}))").match
        self.bare = re.compile(r"[^\s\"']++").match
        self.login = re.compile(r"[^\s/@:?#]++:[^\s/@?#]++@[A-Za-z0-9.-]++(?::[0-9]++)?").match
        self.path = re.compile(r"[/?#][^\s\"'<>]*+").match

    def spans(self, text: str) -> list[tuple[int, str, int]]:
        """(start, kind, end) in code points, by start and then in the order of KINDS."""
        found: list[tuple[int, int, int]] = []
        next_email = next_address = next_chain = next_phone = next_iban = next_bare = next_path = next_groups = next_block = 0
        # cues are known by their small letters; bytes.lower() turns A-Z only, so places stay the same
        lowered = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
        for last, (kind, size) in self.anchors.iter(lowered):
            p = last - size + 1
            if kind == "d":
                if p >= next_chain:
                    if m := self.chain(text, p):
                        next_chain = m.end()
                        digits = m[0].replace(" ", "").replace("-", "")
                        if 14 <= len(digits) <= 19 and luhn(digits):
                            found.append((p, 2, next_chain))
                    else:
                        next_chain = p + 1
                if p >= next_address:
                    if m := self.address(text, p):
                        next_address = m.end()
                        # a part of thousands of digits isn't read as a number: int() has a limit there
                        if all(len(x := part.lstrip("0")) <= 3 and int(x or 0) <= 255 for part in m[0].split(".")):
                            found.append((p, 1, next_address))
                    else:
                        next_address = self.run(text, p).end()
                if p >= 2 and p >= next_iban and text[p - 1].isupper() and text[p - 2].isupper() and not text[p - 3 : p - 2].isalnum() and (m := self.iban(text, p - 2)):
                    code = m[0].replace(" ", "")
                    if 15 <= len(code) <= 34 and iban_valid(code):
                        next_iban = m.end()
                        found.append((p - 2, 4, next_iban))
            elif kind == "@":
                start = p
                while start > next_email and text[start - 1] in self.local:
                    start -= 1
                if start < p and (m := self.domain(text, p + 1)):
                    next_email = m.end()
                    found.append((start, 0, next_email))
            elif kind == "+":
                if p >= next_phone and (m := self.phone(text, p)):
                    next_phone = m.end()
                    if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
                        found.append((p, 3, next_phone))
            elif kind == "/":
                start = p
                while start > 0 and text[start - 1].isascii() and text[start - 1].isalnum():
                    start -= 1
                if start < p and (m := self.login(text, p + 3)):
                    end = m.end()
                    if end < next_path:  # in the path of a URL before: both end together
                        end = next_path if text[end] in "/?#" else end
                    elif m := self.path(text, end):
                        end = next_path = m.end()
                    found.append((start, 7, end))
            elif kind == ":":
                if p >= next_groups:
                    start = p
                    while start > next_groups and text[start - 1] in HEX:
                        start -= 1
                    next_groups = self.groups(text, start).end()
                    if is_ipv6(text, start, next_groups):
                        found.append((start, 8, next_groups))
            elif kind == "b":
                if p >= next_block and (m := self.block(text, p)):
                    end = self.block_end(text, m.end())
                    # without an end there is none for the blocks behind either
                    next_block = end.end() if end else len(text)
                    found.append((p, 6, next_block))
            elif text[p - 1 : p].isalnum():
                continue  # a cue inside a longer word
            elif kind == "k":
                if (match := self.keys.get(text[p : last + 1])) and (m := match(text, p)):
                    found.append((p, 6, m.end()))
            elif kind == "a":
                if (m := self.number(text, last + 1)) and sum(c.isdigit() for c in m[1]) >= 6:
                    found.append((m.start(1), 5, m.end(1)))
            elif m := self.value(text, last + 1):
                if m.lastindex:
                    found.append((m.start(m.lastindex), 6, m.end(m.lastindex)))
                else:
                    if m.end() >= next_bare:  # else in an unquoted value before: both end together
                        next_bare = self.bare(text, m.end()).end()
                    found.append((m.end(), 6, next_bare))
        return [(start, KINDS[k], end) for start, k, end in sorted(set(found))]


def find_private(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans array<struct<kind, start, end>>), one row for each row of df; offsets are code points, end exclusive.

    Null and empty texts have no spans. Null ids and repeated rows are kept as they are. Other columns of df are
    neither read nor returned, so their names can't clash. A map without shuffle: any length of text, any skew.
    """

    def run(batches):
        finder = Finder()
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            rows = [[{"kind": k, "start": a, "end": b} for a, k, b in finder.spans(t)] if t else [] for t in map(pa.StringScalar.as_py, batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, kind)], ["id", "spans"])

    source = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = T.StructType([T.StructField("id", source.schema["id"].dataType), T.StructField("spans", SPAN)])
    return source.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def redact(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text) with each span replaced by its kind in brackets; of spans that overlap the first wins. Null stays null."""

    def run(batches):
        finder = Finder()
        for batch in batches:
            out = []
            for text in batch.column(1).to_pylist():
                parts, at = [], 0
                for start, kind, end in finder.spans(text or ""):
                    if start >= at:
                        parts += [text[at:start], f"[{kind}]"]
                        at = end
                out.append(text if text is None else "".join(parts) + text[at:])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["id", "text"])

    source = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(run, source.schema).toDF(id_col, text_col)


def span_text(spans) -> F.Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def _is(kind: str):
    return lambda x: x["kind"] == kind


def digest(found: DataFrame) -> DataFrame:
    """The counts and digests of find_private()'s rows; n_spans counts all kinds."""
    base = F.filter("spans", lambda x: x["kind"].isin(*BASE_KINDS))
    return found.select(
        "doc_id",
        *(F.size(F.filter("spans", _is(k))).cast("long").alias(f"n_{k}") for k in BASE_KINDS),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2(span_text(base).cast("binary"), 256).alias("base_sha256"),
        span_text(F.col("spans")).alias("spans"),
    )

"""Licence scan by a positional index of rare words, in DataFrame functions only.

Templates are phrases, all of whose words must stand in a file, and whole licence texts, which may be cut or changed here
and there. The index has, for each template, its rarest words (by inverse document frequency over all templates) with their
places. Of a file's words those are looked up that the index has; each occurrence, less the word's place in a template,
says where the template would begin. Where enough rare words of a template agree on the beginning, a phrase is verified
word by word; of a text, whose rare words may lie DRIFT words apart from where they should, the mandatory key phrases must
have been verified in its range, and those that another version has must not.

The index is one literal, so the plan doesn't grow with the templates. The whole scan is one projection: no shuffle, no
explode, a file of any length is one row, and the work is linear in its words but for the sorting of its rare ones.
"""

from __future__ import annotations

import json
import math
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from lattica.llm.licence_texts import KEY_PHRASES, PHRASES, TEXTS

BASE = 3
#: Rare words of a phrase that must agree on where it begins; rare words of a text, and the share of them that must.
RARE, RARE_TEXT, AGREE = 2, 10, 0.7
#: Words by which a text's rare words may stand apart from where they should: one bucket of beginnings; buckets overlap.
DRIFT = 32

LOWER = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: Words after A-Z is lower-cased, and the same words before.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD_ANY_CASE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Template:
    """label: None for a key phrase, which says nothing by itself; drift: 0 for phrases; keys and without: numbers of other templates."""

    label: str | None
    words: tuple[str, ...]
    drift: int
    rare: tuple[tuple[str, int], ...]
    need: int
    weight: int
    keys: tuple[int, ...] = ()
    without: tuple[int, ...] = ()


def idf(texts: list[str]) -> dict[str, float]:
    """The inverse document frequency of each word over the templates."""
    seen = Counter(w for t in texts for w in set(t.split()))
    return {w: math.log(1 + len(texts) / n) for w, n in seen.items()}


def index(phrases=PHRASES, key_phrases=KEY_PHRASES, texts=TEXTS) -> list[Template]:
    """All templates: phrases, key phrases, texts. Ties of rarity go to the longer word, then by code point; a template's weight is a thousand times the IDF of its words, or of a text's rare ones."""
    weight = idf([p for _, p in phrases] + list(key_phrases) + [t for _, t, *_ in texts])

    def rarest(words: list[str], count: int) -> tuple:
        return tuple((w, words.index(w)) for w in sorted(set(words), key=lambda w: (-weight[w], -len(w), w))[:count])

    out = []
    for label, phrase in [*phrases, *((None, p) for p in key_phrases)]:
        words = phrase.split()
        rare = rarest(words, RARE)
        out.append(Template(label, tuple(words), 0, rare, len(rare), round(1000 * sum(weight[w] for w in words))))
    number = {" ".join(t.words): k for k, t in reversed(list(enumerate(out)))}
    for label, text, keys, without in texts:
        words = text.split()
        # of words that come more than once in a text, the place isn't known
        once = [w for w in words if words.count(w) == 1]
        rare = tuple((w, words.index(w)) for w, _ in rarest(once, RARE_TEXT))
        out.append(Template(label, tuple(words), DRIFT, rare, math.ceil(AGREE * len(rare)), round(1000 * sum(weight[w] for w, _ in rare)), tuple(number[k] for k in keys), tuple(number[k] for k in without)))
    return out


def gate(templates: list[Template]) -> str:
    """A pattern that every text with one of the templates holds: long words of which each phrase has one, those of most phrases first; a text needs its key phrases."""
    left, words = [t.words for t in templates if not t.drift], []
    while left:
        count = Counter(w for p in left for w in set(p))
        words.append(max(count, key=lambda w: (len(w) > 6, count[w], len(w), w)))
        left = [p for p in left if not any(words[-1] in w for w in p)]
    return "(?i)" + "|".join(words)


_POSTINGS = "array<struct<word:string,k:int,at:int>>"
_TEMPLATES = "array<struct<label:string,words:array<string>,drift:int,need:int,keys:array<int>,without:array<int>,weight:bigint>>"
_FOUND = "array<struct<phrase:int,starts:array<int>>>"


def _literal(rows: list[dict], kind: str) -> Column:
    return F.from_json(F.lit(json.dumps(rows)), kind)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: list[Template] | None = None) -> DataFrame:
    """(id, n_words, found array<struct<phrase: int, starts: array<int>>>) for each row of docs: where each template begins, words from 0; of a text where its first bucket of beginnings does, which may lie before the file's start.

    Templates are numbered as index() gives them. Null and empty texts have no words and nothing is found. Ids may be null
    or repeat; other columns of docs are not read, so their names can't clash.
    """
    templates = index() if templates is None else templates
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    source = docs.select(F.col(id_col).alias("id"), text.alias("text"))
    gated = source.select("id", F.regexp_extract_all("text", F.lit(WORD_ANY_CASE), F.lit(0)).alias("words"), F.col("text").rlike(gate(templates)).alias("gate"))
    none = F.array().cast("array<string>")
    # a word's lower case differs from that of A-Z only in letters that no template has
    lowered = gated.select("id", F.size("words").cast("long").alias("n_words"), F.when(F.col("gate"), F.transform("words", lambda w: F.translate(w, *LOWER))).otherwise(none).alias("words"))
    wanted = sorted({w for t in templates for w, _ in t.rare})
    pairs = F.transform("words", lambda w, i: F.when(w.isin(*wanted), F.struct(w.alias("word"), i.alias("at"))))
    looked = lowered.select("id", "n_words", "words", F.array_compact(pairs).alias("hits"))

    postings = _literal([{"word": w, "k": k, "at": at} for k, t in enumerate(templates) for w, at in t.rare], _POSTINGS)
    listed = _literal([{"label": t.label, "words": t.words, "drift": t.drift, "need": t.need, "keys": t.keys, "without": t.without, "weight": t.weight} for t in templates], _TEMPLATES)
    of = lambda k: F.get(listed, k)

    def places(hit: Column, p: Column) -> Column:
        """A phrase begins at one place; of a text, a word may belong to either of two buckets."""
        begin, drift = hit["at"] - p["at"], of(p["k"])["drift"]
        low = F.when(drift == 0, begin).otherwise(F.floor(begin / drift).cast("int") - 1)
        high = F.when(drift == 0, begin).otherwise(low + 1)
        return F.transform(F.sequence(low, high), lambda x: F.struct(p["k"].alias("k"), x.alias("place"), hit["word"].alias("word")))

    of_word = lambda h: F.flatten(F.transform(F.filter(postings, lambda p: p["word"] == h["word"]), lambda p: places(h, p)))
    # a word may vote for a text's bucket more than once; in order, equal votes are neighbours
    sorted_votes = looked.withColumn("sorted", F.array_sort(F.flatten(F.transform("hits", of_word))))
    votes = sorted_votes.withColumn("votes", F.filter("sorted", lambda v, i: (i == 0) | (F.get("sorted", i - 1) != v)))
    same = lambda a, b: F.coalesce((a["k"] == b["k"]) & (a["place"] == b["place"]), F.lit(False))
    # votes stand in order, so a place's first vote and the one `need` - 1 behind it tell whether enough agree
    first = lambda v, i: (i == 0) | ~same(F.get("votes", i - 1), v)
    agreed = F.filter("votes", lambda v, i: first(v, i) & same(F.get("votes", i + of(v["k"])["need"] - 1), v))
    agreed = votes.select("id", "n_words", "words", agreed.alias("agreed"))
    whole = lambda v: F.slice("words", F.greatest(v["place"], F.lit(0)) + 1, F.size(of(v["k"])["words"])) == of(v["k"])["words"]
    phrases = F.filter("agreed", lambda v: (of(v["k"])["drift"] == 0) & (v["place"] >= 0) & whole(v))
    verified = agreed.select("id", "n_words", "agreed", phrases.alias("phrases"))

    def holds(v: Column, k: Column) -> Column:
        """Whether phrase k stands in the range of a text."""
        t = of(v["k"])
        low, high = (v["place"] - 1) * t["drift"], (v["place"] + 3) * t["drift"] + F.size(t["words"])
        return F.exists("phrases", lambda f: (f["k"] == k) & (f["place"] >= low) & (f["place"] <= high))

    texts = F.filter("agreed", lambda v: (of(v["k"])["drift"] > 0) & F.forall(of(v["k"])["keys"], lambda k: holds(v, k)) & ~F.exists(of(v["k"])["without"], lambda k: holds(v, k)))
    begins = F.transform(texts, lambda v: F.struct(v["k"].alias("k"), (v["place"] * of(v["k"])["drift"]).alias("place")))
    both = verified.select("id", "n_words", F.concat(F.transform("phrases", lambda v: F.struct(v["k"].alias("k"), v["place"].alias("place"))), begins).alias("both"))
    numbers = F.array_sort(F.array_distinct(F.transform("both", lambda b: b["k"])))
    starts = lambda k: F.transform(F.filter("both", lambda b: b["k"] == k), lambda b: b["place"])
    told = F.transform(numbers, lambda k: F.struct(k.alias("phrase"), starts(k).alias("starts")))
    return both.select(F.col("id").alias(id_col), "n_words", told.cast(_FOUND).alias("found"))


def digest(scanned: DataFrame, id_col: str = "doc_id", templates: list[Template] | None = None) -> DataFrame:
    """Base places, labels and a score: of the label that has most, the share of its templates' weight that is found."""
    templates = index() if templates is None else templates
    labels = F.from_json(F.lit(json.dumps([t.label for t in templates])), "array<string>")
    weights = F.from_json(F.lit(json.dumps([t.weight for t in templates])), "array<bigint>")
    totals = Counter()
    for t in templates:
        totals[t.label] += t.weight
    listed = _literal([{"label": x, "total": n} for x, n in totals.items() if x is not None], "array<struct<label:string,total:bigint>>")
    base = F.filter("found", lambda x: x["phrase"] < BASE)
    starts = F.flatten(F.transform(base, lambda x: x["starts"]))
    named = lambda xs: F.array_join(F.array_sort(F.array_distinct(F.array_compact(F.transform(xs, lambda x: F.get(labels, x["phrase"]))))), ",")
    got = lambda x: F.aggregate(F.filter("found", lambda f: F.get(labels, f["phrase"]) == x["label"]), F.lit(0).cast("long"), lambda a, f: a + F.get(weights, f["phrase"]))
    score = F.when(F.size("found") > 0, F.array_max(F.transform(listed, lambda x: got(x) / x["total"]))).otherwise(0.0)
    return scanned.select(
        id_col,
        "n_words",
        F.size(starts).cast("long").alias("n_base"),
        F.array_min(starts).cast("long").alias("first_word"),
        F.array_max(starts).cast("long").alias("last_word"),
        named(base).alias("base_labels"),
        named(F.col("found")).alias("labels"),
        score.cast("double").alias("score"),
    )


def _oracle() -> str:
    """The same in DuckDB SQL: phrases by comparing every place of every text, texts by counting rare words by bucket."""
    quoted = lambda x: "NULL" if x is None else "'" + x.replace("'", "''") + "'"
    values = lambda rows: ", ".join("(" + ", ".join(quoted(x) if x is None or isinstance(x, str) else str(x) for x in r) + ")" for r in rows)
    templates = list(enumerate(index()))
    rows = values((k, t.label, " ".join(t.words) if not t.drift else "", len(t.words), t.drift, t.need, t.weight, len(t.keys)) for k, t in templates)
    postings = values((k, w, at) for k, t in templates if t.drift for w, at in t.rare)
    keys = values((k, q, own) for k, t in templates for own, qs in ((1, t.keys), (0, t.without)) for q in qs)
    return rf"""
WITH t(k, label, phrase, n, drift, need, weight, n_keys) AS (VALUES {rows}),
p(k, word, spot) AS (VALUES {postings}),
q(k, key, wanted) AS (VALUES {keys}),
d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{LOWER[0]}', '{LOWER[1]}'), '{WORD}') AS w FROM documents
), s AS (
  SELECT doc_id, w, unnest(range(len(w))) AS s FROM d
), m AS (
  SELECT doc_id, s, k, label, weight FROM s JOIN t ON drift = 0 AND s.w[s + 1] = string_split(phrase, ' ')[1] AND array_to_string(s.w[s + 1 : s + n], ' ') = phrase
), v AS (
  SELECT DISTINCT doc_id, p.k, p.word, cast(floor((s - spot) / drift) AS BIGINT) + x.x AS bucket FROM s JOIN p ON s.w[s + 1] = p.word JOIN t USING (k), (VALUES (-1), (0)) x(x)
), a AS (
  SELECT doc_id, k, bucket FROM v JOIN t USING (k) GROUP BY doc_id, k, bucket, need HAVING count(*) >= need
), r AS (
  SELECT a.doc_id, a.k, a.bucket, count(DISTINCT CASE WHEN wanted = 1 THEN key END) AS has, count(CASE WHEN wanted = 0 THEN 1 END) AS bad
  FROM a JOIN t USING (k) JOIN q USING (k) JOIN m ON m.doc_id = a.doc_id AND m.k = key AND m.s BETWEEN (bucket - 1) * drift AND (bucket + 3) * drift + n GROUP BY ALL
), f AS (
  SELECT DISTINCT doc_id, k, label, weight FROM m UNION ALL SELECT DISTINCT doc_id, k, label, weight FROM r JOIN t USING (k) WHERE has = n_keys AND bad = 0
), b AS (
  SELECT doc_id, count(*) AS n_base, min(s) AS first_word, max(s) AS last_word FROM m WHERE k < {BASE} GROUP BY doc_id
), l AS (
  SELECT doc_id, string_agg(label, ',' ORDER BY label) AS labels, string_agg(label, ',' ORDER BY label) FILTER (base) AS base_labels FROM (SELECT doc_id, label, bool_or(k < {BASE}) AS base FROM f WHERE label IS NOT NULL GROUP BY ALL) GROUP BY doc_id
), totals AS (
  SELECT label, sum(weight) AS total FROM t WHERE label IS NOT NULL GROUP BY label
), c AS (
  SELECT doc_id, max(got / total) AS score FROM (SELECT doc_id, label, sum(weight) AS got FROM f GROUP BY ALL) JOIN totals USING (label) GROUP BY doc_id
)
SELECT d.doc_id, cast(len(w) AS BIGINT) AS n_words, cast(coalesce(n_base, 0) AS BIGINT) AS n_base, cast(first_word AS BIGINT) AS first_word, cast(last_word AS BIGINT) AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, cast(coalesce(score, 0) AS DOUBLE) AS score
FROM d LEFT JOIN b USING (doc_id) LEFT JOIN l USING (doc_id) LEFT JOIN c USING (doc_id)
"""


ORACLE = _oracle()

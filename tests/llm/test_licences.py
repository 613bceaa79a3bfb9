import random
import re

from lattica.llm import licences

TEMPLATES = licences.index()
BY_LABEL = {t.label: t for t in TEMPLATES if t.drift}


def words_of(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)


def brute(text):
    """Phrases by comparing every place; texts by trying every bucket of beginnings that a rare word allows."""
    w = words_of(text)
    found = {}
    for k, t in enumerate(TEMPLATES):
        if not t.drift:
            at = [s for s in range(len(w)) if tuple(w[s : s + len(t.words)]) == t.words]
            if at:
                found[k] = at
    phrases = dict(found)
    for k, t in enumerate(TEMPLATES):
        if t.drift:
            begins = [(s - place, word) for word, place in t.rare for s in range(len(w)) if w[s] == word]
            at = []
            for bucket in sorted({(b // t.drift) + x for b, _ in begins for x in (-1, 0)}):
                votes = {word for b, word in begins if bucket * t.drift <= b < (bucket + 2) * t.drift}
                near = lambda q: any((bucket - 1) * t.drift <= s <= (bucket + 3) * t.drift + len(t.words) for s in phrases.get(q, []))  # noqa: B023, E731
                if len(votes) >= t.need and all(map(near, t.keys)) and not any(map(near, t.without)):
                    at.append(bucket * t.drift)
            if at:
                found[k] = at
    return len(w), found


def some_texts():
    r = random.Random(8)
    vocabulary = sorted({w for t in TEMPLATES for w in t.words}) + ["und", "é", "x1"]
    texts = []
    for _ in range(250):
        parts = []
        for _ in range(r.randrange(7)):
            kind = r.random()
            if kind < 0.4:
                parts.append(" ".join(r.choice(TEMPLATES[: len(licences.PHRASES) + len(licences.KEY_PHRASES)]).words))
            elif kind < 0.6:
                own = list(r.choice(list(BY_LABEL.values())).words)
                for _ in range(r.randrange(12)):
                    own[r.randrange(len(own))] = r.choice(vocabulary)
                if r.random() < 0.3:
                    own = own[: r.randrange(1, len(own))]
                parts.append(" ".join(own))
            else:
                parts.append(" ".join(r.choice(vocabulary) for _ in range(r.randrange(40))))
        text = r.choice([" ", "\n", ", "]).join(parts)
        texts.append(text.upper().replace("É", "é") if r.random() < 0.2 else text)
    return texts


def test_against_plain_search(spark):
    rows = list(enumerate(some_texts()))
    rows += [(900, None), (None, ""), (901, "mit license " * 20000), (902, "MIT-License; mit licenses, MİT LİCENSE"), (902, "Apache License")]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, words int, found string")
    got = sorted(((-1 if x["doc_id"] is None else x["doc_id"]), x["n_words"], {f["phrase"]: sorted(f["starts"]) for f in x["found"]}) for x in licences.scan(df).collect())
    key = lambda x: (x[0], x[1])
    want = sorted((((-1 if i is None else i), *brute(t)) for i, t in rows), key=key)
    assert sorted(got, key=key) == want
    assert sum(any(TEMPLATES[k].drift for k in f) for *_, f in want) > 40


def labels(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r["labels"].split(",") for r in licences.digest(licences.scan(df)).orderBy("doc_id").collect()]


def test_texts_and_their_versions(spark):
    r = random.Random(2)
    texts = []
    for t in BY_LABEL.values():
        # a word changed here and there, but for those of the phrases that it needs
        fixed = {w for k in t.keys for w in TEMPLATES[k].words}
        changed = " ".join("other" if w not in fixed and r.random() < 0.03 else w for w in t.words)
        texts += ["Copyright 2001 somebody, " * 3 + " ".join(t.words).capitalize() + ". The rest is prose.", changed]
    # the words of a licence in another order are none, nor are its rare words without its key phrase
    shuffled = list(BY_LABEL["mit text"].words)
    r.shuffle(shuffled)
    texts += [" ".join(shuffled), " ".join(BY_LABEL["mit text"].words).replace("obtaining a copy", "obtaining copies")]
    *found, one, other = labels(spark, texts)
    assert "mit text" not in one and "mit text" not in other
    told = {label: found[2 * k : 2 * k + 2] for k, label in enumerate(BY_LABEL)}
    for label, own in told.items():
        assert all(label in x for x in own), label
    for one, other in (("gpl 2 notice", "gpl 3 notice"), ("bsd 2 clause", "bsd 3 clause"), ("mit text", "isc text"), ("gpl 3 notice", "agpl 3 notice")):
        assert other not in told[one][0] and one not in told[other][0]


def test_digest(spark):
    df = spark.createDataFrame([(1, "See the MIT License. Or the gnu general public license, or MIT license!"), (2, "nothing here"), (3, "all rights reserved"), (4, " ".join(BY_LABEL["zlib"].words))], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in licences.digest(licences.scan(df)).collect()}
    assert (rows[1]["n_base"], rows[1]["first_word"], rows[1]["last_word"], rows[1]["base_labels"], rows[1]["labels"]) == (3, 2, 11, "gpl,mit", "gpl,mit")
    assert rows[1]["score"] == 1.0 and rows[2]["score"] == 0.0 and rows[2]["first_word"] is None
    assert (rows[3]["base_labels"], rows[3]["labels"]) == ("", "proprietary")
    assert (rows[4]["labels"], rows[4]["score"], rows[4]["n_base"]) == ("zlib", 1.0, 0)
    assert licences.digest(licences.scan(df.limit(0))).count() == 0


def test_gate_holds_for_every_template():
    pattern = licences.gate(TEMPLATES)
    for t in TEMPLATES:
        assert re.search(pattern, " ".join(t.words))
        assert t.drift == 0 or t.keys


def test_plan_does_not_grow_with_the_templates(spark):
    df = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    size = lambda ts: len(licences.scan(df, templates=ts)._jdf.queryExecution().analyzed().treeString().split("lambda"))
    assert size(TEMPLATES) == size(TEMPLATES[:3])


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    plan = licences.digest(licences.scan(df))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Exchange", plan)

import random

import numpy as np
import pytest

from lattica.llm import contract, mixing

SF = "/root/testdata/sf0.01"


def filled(sizes, weights, total, most):
    """Targets by doing what the rule says, step by step."""
    names = sorted((x for x in sizes if x is not None)) + [None] * (None in sizes)
    w = {n: weights[k % len(weights)] for k, n in enumerate(names)}
    want, out, free = total * sum(sizes.values()), {}, set(names)
    while free:
        level = (want - sum(out.values())) / sum(w[n] for n in free)
        over = {n for n in free if level * w[n] > most * sizes[n]}
        if not over:
            out |= {n: level * w[n] for n in free}
            break
        out |= {n: most * sizes[n] for n in over}
        free -= over
    return out


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 100, "c": 100}, {"a": 10, "b": 500, "c": 1000, "d": 3, None: 50}, {"a": 1000, "b": 1, "c": 1, "d": 1}, {"x": 7}, {"a": 0, "b": 5}])
def test_targets(spark, sizes):
    df = spark.createDataFrame([(n or "", n, s) for n, s in sizes.items()], "key string, source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.capped_targets(df).collect()}
    want = filled(sizes, mixing.WEIGHTS, mixing.TOTAL, mixing.MOST)
    assert got == {k: pytest.approx(v) for k, v in want.items()}


def test_query(spark):
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = contract.op5_mixing(spark, SF).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(docs)
    taken, sizes, targets = {}, {}, {}
    for r in rows:
        d = docs[r["doc_id"]]
        assert r["size"] == len([w for w in __import__("re").split("[\x20\x09-\x0d]+", d["text"]) if w])
        assert r["taken"] <= 2 * r["size"]
        taken[d["source"]] = taken.get(d["source"], 0) + r["taken"]
        sizes[d["source"]] = r["source_size"]
        targets[d["source"]] = r["target"]
    want = filled(sizes, mixing.WEIGHTS, mixing.TOTAL, mixing.MOST)
    largest = max(r["size"] for r in rows)
    for s in sizes:
        assert targets[s] == pytest.approx(want[s])
        assert abs(taken[s] - targets[s]) <= largest
    at = [r["position"] for r in rows]
    known = [p for p in at if p is not None]
    assert known == sorted(known) and at[: len(known)] == known and all(0 <= p <= 1 for p in known)
    assert [tuple(r) for r in contract.op5_mixing(spark, SF).collect()] == [tuple(r) for r in rows]


def test_edges(spark):
    df = spark.createDataFrame([(1, None, "a", 1), (None, "x y", None, 1), (2, "", "a", 1), (3, "p q", "a", 1), (3, "p q", "a", 1)], "doc_id long, text string, source string, size int")
    rows = mixing.mix(df, carry=("size",)).select("doc_id", "taken", "source_size").collect()
    assert len(rows) == 5 and {r["source_size"] for r in rows} == {2, 4}
    assert all(r["taken"] == 0 for r in rows if r["doc_id"] in (1, 2))
    assert mixing.mix(df.limit(0)).count() == 0


@pytest.mark.parametrize("ids", ["null", "shared"])
def test_rows_without_an_id_of_their_own(spark, ids):
    # rows are told apart by n
    rows = [(None if ids == "null" else k % 3, " ".join([f"t{k}"] * (1 + k % 7)), "aabc"[k % 4], k) for k in range(400)] + [(None, None, "a", 400), (None, "", "c", 401)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n long").repartition(3)
    plan = {r["n"]: r for r in mixing.mix(df, carry=("n",)).collect()}
    got = mixing.mixed(df).collect()
    passes = {k: sum(r["n"] == k for r in got) for k in plan}
    assert passes == {k: r["taken"] // r["size"] if r["size"] else 0 for k, r in plan.items()}
    assert {tuple(r) for r in got} <= set(rows)
    taken = {s: sum(len(r["text"].split()) for r in got if r["source"] == s) for s in "abc"}
    for r in plan.values():
        assert abs(taken[r["source"]] - r["target"]) <= 7


def used_by(t, slope):
    """The share of its words that a source has used up to t, by summing its schedule in small steps."""
    steps = np.linspace(0, t, 2001)
    weight = (1 + slope) - 2 * slope * steps
    return float(np.sum((weight[1:] + weight[:-1]) / 2 * np.diff(steps)))


def test_every_pass_stands_where_demand_reaches_it(spark):
    r = random.Random(3)
    rows = [(k, " ".join(["w"] * r.randrange(1, 9)), "abcd"[min(3, k % 5)]) for k in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    laid = mixing.positions(mixing._plan(df, laid_out=True)).collect()
    assert all(0 <= x["at"] <= 1 for x in laid)
    by_source = {}
    for x in laid:
        by_source.setdefault(x["source"], []).append(x)
    for own in by_source.values():
        own.sort(key=lambda x: (x["pass"], x["mix_start"]))
        slope, target = own[0]["mix_slope"], own[0]["target"]
        at = [x["at"] for x in own]
        assert at == sorted(at)  # passes follow one another
        before = 0
        for k, x in enumerate(own):
            if k % 97 == 0:
                assert abs(used_by(x["at"], slope) - min(1, before / target)) < 1e-6
            before += x["size"]
        # what each tenth of training takes is what the schedule says, but for a document at either end
        for tenth in range(10):
            want = target * (used_by((tenth + 1) / 10, slope) - used_by(tenth / 10, slope))
            got = sum(x["size"] for x in own if tenth / 10 <= x["at"] < (tenth + 1) / 10)
            assert abs(got - want) <= 18, (own[0]["source"], tenth)
    assert any(own[-1]["pass"] > 0 for own in by_source.values())
    order = [x["doc_id"] for x in mixing.mixed(df).select("doc_id").collect()]
    want = [x["doc_id"] for x in sorted(laid, key=lambda x: x["at"])]
    assert sorted(order) == sorted(want)
    assert _agree(order, laid)


def _agree(order, laid):
    """Whether documents stand in the order of their positions, those of equal ones in any."""
    at = sorted(x["at"] for x in laid)
    left = {}
    for x in laid:
        left.setdefault(x["doc_id"], []).append(x["at"])
    return all(any(abs(p - a) < 1e-12 for p in left[k]) for k, a in zip(order, at))

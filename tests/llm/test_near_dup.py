import random
import re
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from prefweave.llm.groups import components
from prefweave.llm import near_dup
from prefweave.llm.near_dup import Join, Order, Sets, entries_of, link_counts, linked_sets, similar_pairs, tree_join
from prefweave.llm.oracle import ORACLE
from prefweave.llm.queries import QUERIES
from tests.oracle import connection, same

CHAT = "array<struct<role:string,content:string>>"
SCHEMA = f"row_index bigint, chosen {CHAT}, rejected {CHAT}, fp int, key string, runs int"
SMALL = {"sketch_bits": 12}


def brute(records, k, threshold):
    sets = {}
    for i, *chats in records:
        s = set()
        for c in chats:
            for m in c or ():
                w = re.findall(r"[^\W_]+", (m["content"] or "").lower()) if m else []
                s.update(tuple(w[j : j + k]) for j in range(len(w) - k + 1))
        sets[i] = s
    ids = sorted(sets)
    return {(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if sets[a] and sets[b] and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b])}


def chat(*contents):
    return [{"role": "user", "content": c} for c in contents]


def corpus(seed, n=60):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(120)]
    prompt = " ".join(r.choice(vocabulary) for _ in range(12))
    out = []
    for i in range(n):
        if out and r.random() < 0.6:
            base = r.choice(out)
            words = base[1][1]["content"].split()
            for _ in range(r.randint(0, 9)):
                j = r.randrange(len(words) + 1)
                words[j : j + r.randint(0, 1)] = [r.choice(vocabulary)] * r.randint(0, 1)
        else:
            words = [r.choice(vocabulary) for _ in range(r.randint(0, 40))]
        out.append((i * 3, chat(prompt if r.random() < 0.3 else None, " ".join(words)), None if r.random() < 0.2 else chat(" ".join(reversed(words)))))
    return out


def frame(spark, records):
    return spark.createDataFrame([(*r, 1, "clash", 2) for r in records], SCHEMA)


@pytest.mark.parametrize(("seed", "k", "threshold", "entries"), [(0, 3, Fraction(1, 2), 10**6), (1, 3, Fraction(1, 2), 7), (2, 2, Fraction(4, 5), 9), (3, 5, Fraction(4, 5), 10**6)])
def test_pairs_equal_brute_force(spark, seed, k, threshold, entries):
    records = corpus(seed)
    got = similar_pairs(frame(spark, records), "row_index", ["chosen", "rejected"], Join(k=k, threshold=threshold, slices=3, entries=entries, **SMALL))
    assert {tuple(r) for r in got.select("row_index_a", "row_index_b").collect()} == brute(records, k, threshold)


def test_edges(spark):
    text = "one two three four five six"
    records = [(1, chat(text), None), (2, [None, {"role": "user", "content": text}], []), (2, chat(text), None), (3, chat("one two"), None), (4, None, None), (5, chat(""), chat(None)), (None, chat(text), None), (6, chat(" ".join(f"x{i}" for i in range(30000)) + text), None)]
    got = similar_pairs(frame(spark, records), "row_index", ["chosen", "rejected"], Join(k=3, threshold=Fraction(1, 2), **SMALL))
    assert {tuple(r) for r in got.collect()} == {(1, 2)}
    assert similar_pairs(frame(spark, records).where("row_index > 9"), "row_index", ["chosen"], Join(**SMALL)).count() == 0


def test_several_buckets_to_a_task(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "_TASKS", 3)
    records = corpus(8)
    got = similar_pairs(frame(spark, records), "row_index", ["chosen", "rejected"], Join(k=3, threshold=Fraction(1, 2), slices=3, entries=20, **SMALL))
    assert {tuple(r) for r in got.collect()} == brute(records, 3, Fraction(1, 2))


def test_a_large_class_keeps_all_its_links(spark):
    text = "one two three four five six seven eight"
    records = [(i, chat(text + "!" * (i % 9)), None) for i in range(30)] + [(100, chat(text + " nine"), None)]
    df = frame(spark, records)
    got = {tuple(r) for r in similar_pairs(df, "row_index", ["chosen", "rejected"], Join(k=3, threshold=Fraction(1, 2), **SMALL)).collect()}
    assert got == brute(records, 3, Fraction(1, 2))
    links, members = linked_sets(df, "row_index", ["chosen", "rejected"], Join(k=3, threshold=Fraction(1, 2), **SMALL))
    assert links.count() == 1 and members.count() == 31


def ordered_entries(records, slices, entries, buckets, threshold=0.5):
    texts = [m["content"] for _, c, _ in records for m in c]
    rows = np.array([i for i, (_, c, _) in enumerate(records) for _ in c])
    s = Sets(texts, rows, len(records), 3)
    counts = np.bincount((s.run & np.uint64((1 << 16) - 1)).astype(np.int64), minlength=1 << 16).astype(np.uint32)
    send = np.zeros(len(records), bool)
    send[np.unique(s.fp, return_index=True)[1]] = True
    return s, entries_of(s, send & (s.size > 0), Order(counts, entries), threshold, slices, buckets)


def prompted(n, prompt, own, seed=0):
    """Records that share one long prompt and have ``own`` words for themselves."""
    r = random.Random(seed)
    shared = " ".join(f"p{i}" for i in range(prompt))
    return [(i, chat(shared, " ".join(f"v{r.randrange(10**6)}" for _ in range(own))), None) for i in range(n)]


def joined(e, threshold=Fraction(1, 2)):
    out = set()
    for b in np.unique(e["bucket"]):
        m = e["bucket"] == b
        for x, y in tree_join({c: v[m] for c, v in e.items() if c != "bucket"}, threshold):
            out |= set(zip(x.tolist(), y.tolist(), strict=True))
    return out


def test_entries_do_not_depend_on_buckets():
    records = corpus(5, 300)
    few, many = (ordered_entries(records, 6, 10**6, n)[1] for n in (1, 139))
    assert len(few["fp"]) == len(many["fp"])
    # four times the 0.54 KB that a record of 131 runs takes in its table: so many bytes for a run
    s, e = ordered_entries(prompted(400, 60, 75), 6, 10**6, 139)
    packed = near_dup._packed([e])
    assert sum(len(x.as_py()) for x in packed.column("data")) <= 4 * 540 / 131 * s.size.sum()


def test_packing_is_exact():
    records = corpus(6, 80) + [(999, chat(" ".join(f"z{i}" for i in range(5000))), None), (1000, chat(" ".join(f"z{i}" for i in range(4990))), None)]
    _, e = ordered_entries(records, 2, 10**6, 3)
    packed = near_dup._packed([e])
    back = [near_dup._unpacked(memoryview(x.as_py())) for x in packed.column("data")]
    rows = lambda x: sorted(zip(*(x[c].tolist() for c, _ in near_dup.ENTRY), strict=True))
    assert rows({c: np.concatenate([b[c] for b in back]) for c, _ in near_dup.ENTRY}) == rows(e)


def test_cells_of_a_hot_run_lose_no_pair():
    records = prompted(300, 90, 20)
    plain, split = joined(ordered_entries(records, 3, 10**6, 5)[1]), joined(ordered_entries(records, 3, 40, 5)[1])
    assert len(plain) == 300 * 299 // 2 and split == plain
    # the entries of one cell are about those of two blocks, however hot the run
    _, e = ordered_entries(records, 3, 40, 10**6)
    assert np.bincount(np.unique(e["bucket"], return_inverse=True)[1]).max() < 6 * 40


def test_unlike_records_with_a_common_prompt_are_no_candidates():
    """A prompt of a third of each record makes hardly any candidates, of more than two thirds makes pairs."""
    pairs = 1000 * 999 // 2
    assert len(joined(ordered_entries(prompted(1000, 40, 84), 6, 10**6, 4)[1])) < pairs / 50


def test_order_of_a_full_sketch():
    counts = np.random.default_rng(1).integers(0, 10**6, 1 << 12).astype(np.uint32)
    o = Order(counts, 500)
    at = np.argsort(counts)
    assert (np.diff(o.scale[at].astype(int)) >= 0).all() and o.base.max() + o.wide.max() <= 254 + 254 and (np.diff(o.base) >= 0).all()


def test_queries_of_large_classes(spark, tmp_path):
    text = "one two three four five six seven eight"
    records = [(i, chat(text + "!" * (i % 20)), None) for i in range(40)] + [(100, chat(text + " nine"), None), (101, chat(text + " nine"), None), (200, chat("a b c d"), None)]
    frame(spark, records).write.parquet(f"{tmp_path}/dataset.parquet")
    con = connection(tmp_path / "none")
    con.execute(f"create view dataset as select * from '{tmp_path}/dataset.parquet/*.parquet'")
    same(QUERIES["p1_found"](spark, str(tmp_path)), con, ORACLE["p1_found"])
    got = {tuple(r) for r in QUERIES["p1_groups"](spark, str(tmp_path)).select("row_index", "group_id", "n_links").collect()}
    assert got == {(i, 0, 41) for i in (*range(40), 100, 101)} | {(200, 200, 0)}


def test_link_counts_of_keys_in_several_classes(spark):
    records = corpus(7) + [(r[0] // 2 * 2, *r[1:]) for r in corpus(7)[:30]]
    join = Join(k=3, threshold=Fraction(1, 2), **SMALL)
    pairs = similar_pairs(frame(spark, records), "row_index", ["chosen", "rejected"], join).collect()
    got = {r["key"]: r["n_links"] for r in link_counts(*linked_sets(frame(spark, records), "row_index", ["chosen", "rejected"], join)).collect()}
    assert got == Counter(x for r in pairs for x in r)


@pytest.mark.parametrize("bad", [{"k": 0}, {"threshold": Fraction(0)}, {"slices": 17}, {"entries": 0}])
def test_parameters_are_checked(bad):
    with pytest.raises(ValueError):
        Join(**bad)


def test_text_columns(spark):
    df = spark.createDataFrame([("a", "p q r s t u"), ("b", "P, q; r s t u!"), ("c", None)], "id string, text string")
    assert [tuple(r) for r in similar_pairs(df, "id", ["text"], Join(**SMALL)).collect()] == [("a", "b")]


def test_tree_join_on_random_sets():
    for seed in range(12):
        r = np.random.default_rng(seed)
        records = [(i, chat(" ".join(f"w{x}" for x in r.choice(14, r.integers(3, 40)))), None) for i in range(60)]
        for threshold in (Fraction(1, 2), Fraction(4, 5)):
            for slices, entries in ((1, 10**6), (3, 5)):
                s, e = ordered_entries(records, slices, entries, 3, float(threshold))
                sets = {int(s.fp[i] & near_dup._FP): set(s.run[s.bound[i] : s.bound[i + 1]].tolist()) for i in range(60)}
                ids = sorted(sets)
                want = {(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if sets[a] and sets[b] and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b])}
                assert want <= joined(e, threshold)


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 101), (103, 101), (7, 7), (None, 3)]
    got = dict(tuple(r) for r in components(spark.createDataFrame(links, "a bigint, b bigint"), "a", "b").collect())
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 103: 100}
    assert components(spark.createDataFrame([], "a bigint, b bigint"), "a", "b").count() == 0

import random
import re
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from prefweave.llm.leak import Automaton, Items, leaks, without_leaks
from prefweave.llm.pairs import Rules, broken_pairs, defect, is_refusal, is_truncated
from prefweave.llm.repetition import Limits, host_verdicts, measure, repeated_words, repetition
from prefweave.llm.split import _structure, LEVELS, pieces_of, split_texts
from prefweave.llm.tokens import _kind, encode_corpus, encoder, halves, must_split

WORD = re.compile(r"[^\W_]+")


# ---- repetition


def brute_repeated(text, k):
    w = [x.lower() for x in WORD.findall(text or "")]
    seen, marked = set(), [False] * len(w)
    for i in range(len(w) - k + 1):
        run = tuple(w[i : i + k])
        if run in seen:
            marked[i : i + k] = [True] * k
        seen.add(run)
    return len(w), sum(marked)


@settings(deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab .", max_size=60)), max_size=6), st.integers(1, 6))
def test_repeated_words(texts, k):
    n, r = repeated_words(texts, k)
    assert list(zip(n.tolist(), r.tolist(), strict=True)) == [brute_repeated(t, k) for t in texts]


def answers(spark):
    loop = "we go round and round again " * 6
    rows = [(1, "h", loop, "plain words here", 1), (1, "h", "older", "plain words here", 0), (2, "h", None, "", 1), (3, None, "a b c d e f g a b c d e f", "x\nx\nx", 1), (None, "h", loop, loop, 1), (4, "g", "z " * 30000, "ok", 1)]
    return spark.createDataFrame(rows, "id bigint, host_kind string, a string, b string, v int").selectExpr("*", "'clash' as share", "1 as host")


def test_repetition_measures_and_verdicts(spark):
    got = {(r["id"], r["side"]): r for r in repetition(answers(spark), "id", {"a": "a", "b": "b"}, ["host_kind"], "v").collect()}
    assert len(got) == 8
    # the first of the six rounds is new
    assert (got[1, "a"]["n_words"], got[1, "a"]["n_repeated"]) == (36, 30) and got[1, "a"]["failed"]
    assert got[2, "a"]["share"] == 0 and not got[2, "a"]["failed"] and got[2, "b"]["n_words"] == 0
    assert got[3, "b"]["line_share"] == pytest.approx(2 / 3) and got[3, "a"]["n_repeated"] == 6
    assert got[4, "a"]["n_repeated"] == 29999
    assert got[3, "a"]["host"] == "a/-" and {r["host_verdict"] for r in got.values()} <= {"suspect", "sound"}
    empty = repetition(answers(spark).where("id > 9"), "id", {"a": "a"}, ["host_kind"], "v")
    assert empty.count() == 0


def test_small_hosts_are_shrunk(spark):
    rows = [("big", i < 90) for i in range(100)] + [("good", False)] * 100 + [("tiny", True)]
    df = spark.createDataFrame(rows, "host string, failed boolean")
    rate = {r["host"]: r["host_rate"] for r in host_verdicts(df, Limits()).collect()}
    assert rate["good"] < 0.1 < rate["tiny"] < 1 and 0.8 < rate["big"] <= 0.9
    one = host_verdicts(df.where("host = 'tiny'")).first()
    assert one["host_rate"] == pytest.approx(1.0)
    assert measure(answers(spark), "id", {"a": "a"}, []).count() == 4


# ---- encoding

PIECES = ["a", "b", "th", "ing", " ", "  ", "\n", "\t", "'", "'s", "s", "1", "23", "!", "?!", "é", "あ", "漢字", "🙂", "​", "́", "<|endoftext|>", "don't", "_"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=120), st.sampled_from([1, 3, 7, 20, 64]))
def test_tree_encoding_is_exact(parts, leaf):
    e, text = encoder("byte_bpe_50k"), "".join(parts)
    assert e.encode_long(text, leaf) == e.encode(text)


@pytest.mark.parametrize("unit", ["a", "ab", " ", "あ", "!?", " \n", "1", "abcdefghij", "é"])
def test_runs_without_breaks(unit):
    e, text = encoder("byte_bpe_50k"), unit * 5000
    assert e.encode_long(text, 512) == e.encode(text)


def test_split_places_need_no_context():
    e, r = encoder("byte_bpe_50k"), random.Random(0)
    for _ in range(3000):
        text = "".join(r.choice(PIECES) for _ in range(r.randint(2, 12)))
        for i in range(1, len(text)):
            if must_split(text, i):
                assert e.encode(text[:i]) + e.encode(text[i:]) == e.encode(text)
    assert "".join(halves("abcdefg", 2)) == "abcdefg" and max(map(len, halves("abcdefg", 2))) <= 2
    assert _kind(chr(0x378)) == -1 and unicodedata.category(chr(0x378)) == "Cn"


def test_encode_corpus(spark):
    from tokenizers import Tokenizer

    long = "Some words, 12 of them; and 漢字 too.\n" * 60
    rows = [(1, "hello <|endoftext|> world"), (2, ""), (3, None), (4, long), (4, long), (None, "x"), (5, "é" * 900)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id bigint, text string, ids string")
    got = [(r["doc_id"], r["ids"]) for r in encode_corpus(df, "doc_id", "text", leaf=100).collect()]
    t = Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    t.encode_special_tokens = True
    want = [(k, t.encode(x, add_special_tokens=False).ids if x else []) for k, x in rows]
    order = lambda x: (x[0] is None, x[0] or 0, x[1])
    assert sorted(got, key=order) == sorted(want, key=order)
    assert encode_corpus(df.where("doc_id > 9"), "doc_id", "text").count() == 0


# ---- leaks


def brute_leaks(docs, items, least):
    def grams(t):
        w = [x.lower() for x in WORD.findall(t or "")]
        return {tuple(w[i : i + least]) for i in range(len(w) - least + 1)}

    return {(d, i) for d, t in docs for i, x in items if grams(t) & grams(x)}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="abc", max_size=25), max_size=6), st.text(alphabet="abcd", max_size=40), st.integers(1, 5))
def test_scan_finds_every_passage(items, doc, least):
    texts = tuple(" ".join(i) for i in items)
    got = {}
    for _, a, b, found, n in Items(texts, least).scan([" ".join(doc)]):
        assert b - a == 2 * n - 1
        for i in found:
            got[i] = max(got.get(i, 0), n)
    want = {}
    for i, x in enumerate(items):
        longest = max((n for n in range(1, len(x) + 1) for s in range(len(x) - n + 1) if x[s : s + n] in doc), default=0)
        if longest >= least:
            want[i] = longest
    assert got == want


def test_leaks(spark):
    passage = "The quick brown fox jumps over the lazy dog near the old stone bridge at dawn"
    items = [(1, passage), (2, "different start " + passage), (3, None), (4, ""), (5, "too short")]
    docs = [(10, f"x {passage.upper().replace(' ', ' -- ')} y"), (11, "nothing"), (12, None), (13, ""), (14, " ".join(passage.split()[:11])), (15, "w " * 50000 + passage), (10, "again"), (None, passage)]
    d = spark.createDataFrame([(*r, "clash") for r in docs], "doc_id bigint, text string, item_id string")
    i = spark.createDataFrame(items, "item_id bigint, content_text string")
    got = {(r["doc_id"], r["item_id"]): r for r in leaks(d.drop("item_id"), "doc_id", "text", i, "item_id", "content_text").collect()}
    assert set(got) == brute_leaks([x for x in docs if x[0]], items, 12) == {(10, 1), (10, 2), (15, 1), (15, 2)}
    assert got[10, 1]["longest"] == 16 and got[10, 1]["coverage"] == 1.0 and got[10, 2]["longest"] == 16
    blocks = leaks(d.drop("item_id"), "doc_id", "text", i, "item_id", "content_text", most_bytes=1)
    assert {(r["doc_id"], r["item_id"]) for r in blocks.collect()} == set(got)
    clean = {r["doc_id"]: r for r in without_leaks(d, "doc_id", "text", i, "item_id", "content_text").collect() if r["doc_id"]}
    assert clean[10]["text"] == "x   y" and clean[10]["spans"] == 1 and set(clean) == {10, 15}
    cleaned = lambda **k: sorted(map(repr, without_leaks(d, "doc_id", "text", i, "item_id", "content_text", **k).collect()))
    assert cleaned() == cleaned(most_bytes=1)
    assert leaks(d.drop("item_id"), "doc_id", "text", i.where("item_id > 9"), "item_id", "content_text").count() == 0
    assert leaks(d.where("doc_id > 99").drop("item_id"), "doc_id", "text", i, "item_id", "content_text").count() == 0


def test_automaton_knows_every_part():
    a = Automaton([[1, 2, 1, 3], [2, 1, 2]])
    for s in ([1, 2, 1, 3], [2, 1, 2], [1, 3], [2]):
        state = 0
        for c in s:
            state = a.next[state][c]
        assert state
    assert a.items[a.next[a.next[0][1]][2]] == {0, 1}


# ---- splitting


def levels_of(text):
    return [(text[i:].split("\n")[0][:12], LEVELS[k]) for i, k in zip(*_structure(text), strict=True)]


def test_structure_of_nested_lists_and_markup():
    assert levels_of("a\n- b\n  - c\n    - d\n  - e\n- f\n\n    code\n\n# g") == [("- b", "line"), ("  - c", "inner line"), ("    - d", "inner line 2"), ("  - e", "inner line"), ("- f", "line"), ("    code", "inner line"), ("# g", "heading 1")]
    html = "<h2>t</h2><p>x</p><ul><li>a<ul><li>b</li></ul></li><li>c</li></ul><table><tr><td>1</td></tr></table>"
    assert [k for _, k in levels_of(html)] == ["paragraph", "paragraph", "line", "inner line", "inner line", "line", "paragraph", "line", "inner line"]
    assert levels_of("```\n<p>\n# x\n```\n<p>y") == [("<p>", "inner line"), ("# x", "inner line"), ("```", "inner line"), ("<p>y", "paragraph")]
    assert levels_of("") == levels_of("1 < 2 and <b>bold</b>") == []


def test_markup_is_cut_at_rows():
    e = encoder("byte_bpe_50k")
    row = "<tr><td>some cell with words</td><td>another cell with words</td></tr>"
    text = "<table>" + row * 60 + "</table>"
    own = pieces_of(text, e, 128, 0)
    assert len(own) > 5 and all(text.startswith("<tr>", a) for _, a, *_ in own[1:]) and "".join(text[x:b] for _, x, b, *_ in own) == text


@settings(max_examples=80, deadline=None)
@given(st.lists(st.sampled_from([*PIECES, "word ", "Sentence one. ", "# Head\n\n", "\n\n", "- item\n", "```\n", "line\n"]), max_size=150), st.sampled_from([20, 33, 64]))
def test_pieces_keep_the_text(parts, limit):
    e, text, overlap = encoder("byte_bpe_50k"), "".join(parts), 6
    own = pieces_of(text, e, limit, overlap, 64)
    assert bool(own) == (len(e.encode(text)) > limit)
    if own:
        assert "".join(text[x:b] for _, x, b, _, _ in own) == text
        assert all(n <= limit and n == len(e.encode(text[a:b])) for a, _, b, n, _ in own)
        assert all(a <= x for a, x, *_ in own) and own[0][0] == own[0][1] == 0


def test_natural_boundaries(spark):
    section = lambda n: f"## Part {n}\n\n" + "Some words stand here. " * 12 + "\n\n"
    text = "# Title\n\n" + "".join(map(section, range(8)))
    rows = [(1, text), (2, "short"), (3, None), (4, ""), (5, "x" * 2000), (1, text)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id bigint, text string, piece string")
    got = split_texts(df, "doc_id", "text", limit=200, overlap=16).collect()
    assert {r["doc_id"] for r in got} == {1, 5}
    mine = sorted((r["piece"], r["cut"], r["text"][r["n_repeated"] :]) for r in got if r["doc_id"] == 1)[::2]
    assert [c for _, c, _ in mine[1:]] == ["heading 2"] * (len(mine) - 1) and "".join(t for *_, t in mine) == text
    assert all(r["n_tokens"] <= 200 for r in got)
    assert {r["cut"] for r in got if r["doc_id"] == 5} == {"", "character"}
    with pytest.raises(ValueError):
        split_texts(df, "doc_id", "text", limit=100, overlap=50)


# ---- broken pairs

U, A = (lambda c: {"role": "user", "content": c}), (lambda c: {"role": "assistant", "content": c})
ASK = "Why do the tailors in the town repair the old bridge before the winter?"


@pytest.mark.parametrize(
    ("answer", "want"),
    [
        ("They repair it because the river freezes. It is safer that way.", None),
        ("Yes.", None),
        ("244 metres", None),
        ("Yes", None),
        (None, "empty"),
        (" \n", "empty"),
        ("?! —", "empty"),
        (ASK, "copies_prompt"),
        (f'You asked: "{ASK}"', "copies_prompt"),
        (f"{ASK} {ASK}", "copies_prompt"),
        (ASK.replace("old ", "").upper(), "copies_prompt"),
        (f"{ASK} Because ice breaks the piers, and the masons come only when the harvest is over and paid for, as they did last year.", None),
        ("I'm sorry, but I can’t help with that. Feel free to ask me about another subject.", "refusal"),
        ("Leider darf ich nicht darauf eingehen. Bitte frag mich etwas anderes.", "refusal"),
        ("I'm sorry to hear that. The bridge is old, so they repair it.", None),
        ("I can't help with that. The bridge is old, so they repair it before the ice comes.", None),
        ("An honest assistant would decline to flatter you here: the bridge is old and weak.", None),
        ("They repair it because the river free", "truncated"),
        ("They repair it, because the river,", "truncated"),
        ("They repair it (as the river", "truncated"),
        ("1. The river freezes.\n2. The masons", "truncated"),
        ("1. The river freezes.\n2.", "truncated"),
        ("Look:\n- a river\n- an old bridge\n- ice", None),
        ("Look:\n- a cold river\n- an old bridge\n- some", "truncated"),
        ("Here.\n\n```\nx = 1\n", "truncated"),
        ("Here.\n\n```\nx = 1\n```", None),
        ("**It is old, and they like it.**", None),
        ("It is old and they like it. Good luck 👍", None),
        ("Weil der Fluss im Winter zufriert und die Brücke dann nicht mehr sicher ist.", "other_language"),
        ("They do. A sign there says “die Brücke ist im Winter nicht sicher”. It is old.", None),
    ],
)
def test_defects(answer, want):
    assert defect([U(ASK), A(answer)], None) == want


@pytest.mark.parametrize(
    ("answer", "want"),
    [
        ("They repair it (see\nthe note. It is old.", "truncated"),
        ("They repair it (as " + "it is old, and " * 40 + "they like it.", "truncated"),
        ("- It is [old.\n- They like it.", "truncated"),
        ("They repair it (see\n\n```\nx = 1\n```", "truncated"),
        ("They repair it {as 👍", "truncated"),
        ("They repair it. (See note.)", None),
        ("They repair it (see\nthe note). It is old.", None),
        ("a) It is old.\nb) They like it.", None),
        ("It lies in [0, 1) or (1, 2]. It is old.", None),
        ("Use `(` here. Sad :( but true :-( It is old.", None),
        ("Here.\n\n```\nf(x\n```\nIt is old.", None),
    ],
)
def test_brackets_of_the_whole_answer(answer, want):
    assert defect([U(ASK), A(answer)], None) == want


def test_long_refusals():
    no = "I'm sorry, but I can't help with that question about the bridge. "
    assert defect([U(ASK), A(no * 30)], None) == "refusal"
    assert defect([U(ASK), A(no + "Thank you for your patience with me today. " * 40)], None) == "refusal"
    assert defect([U(ASK), A(no * 150)], None) == "refusal"
    one = "I'm sorry, but I can't help with that" + ", nor with anything like it" * 80 + "."
    assert defect([U(ASK), A(one)], None) == "refusal"
    assert defect([U(ASK), A(one)], None, Rules(refusal_words=40)) is None
    assert defect([U(ASK), A(no * 30 + "The bridge is old, so they repair it.")], None) is None


def test_refusals_by_subject_negation_and_act():
    for no in (
        "I'm afraid I can't do this for you.", "I won't be able to assist with this.", "I must respectfully refrain from offering an opinion here.", "Regrettably, I cannot fulfil this request.",
        "Dabei kann ich Ihnen nicht behilflich sein.", "Leider muss ich diese Bitte zurückweisen.", "Je ne souhaite pas répondre à cette question.", "No estoy autorizado para responder a esa pregunta.",
        "Я не стану отвечать на этот вопрос.", "Мне не разрешено обсуждать эту тему.", "I apologize, but I cannot generate that content.", "К сожалению, помочь не могу.",
    ):
        assert is_refusal(no), no
    for answer in ("He said he could not help them.", "The law does not allow you to answer for others.", "I would not go into the forest alone.", "I don't share that view, because the bridge was safe.", "Ich war nicht dort.", "Unfortunately the bridge was closed, because the ice was thin.", "Leider war die Brücke im Winter gesperrt.", "I can't find an error in it.", "No, the bridge was not closed."):
        assert not is_refusal(answer), answer


def test_open_brackets_anywhere():
    filler = "The bridge was closed for the winter and opened again. " * 80
    assert defect([U(ASK), A("It was closed (as they say. " + filler)], None) == "truncated"
    assert defect([U(ASK), A("First line [open\n" + filler + "\nThe end.")], None) == "truncated"
    assert defect([U(ASK), A("It was closed (as they say). " + filler)], None) is None


def test_the_latest_delivery_counts(spark):
    good = [U(ASK), A("Because the river freezes in winter and the ice presses on it.")]
    rows = [(1, good, [], 1), (1, good, good[:1] + [A("No.")], 2), (2, [], good, None), (2, good, good, 0), (3, [], good, 5), (3, [], good, 5)]
    df = spark.createDataFrame(rows, "row_index bigint, chosen array<struct<role:string,content:string>>, rejected array<struct<role:string,content:string>>, at int")
    assert sorted(tuple(r) for r in broken_pairs(df, "row_index", version="at").collect()) == [(3, "chosen", "empty")]
    assert {r["row_index"] for r in broken_pairs(df, "row_index").collect()} == {1, 2, 3}


def test_prompts_and_chats():
    german = "Weil der Fluss im Winter zufriert und die Brücke dann nicht mehr sicher ist."
    assert defect([U(ASK + " Answer in German, please."), A(german)], None) is None
    assert defect(None, None) == defect([], None) == defect([U(ASK)], None) == defect([None], None) == "empty"
    assert defect([{"role": None, "content": "x"}], None) == "empty"
    # the prompt of the other side, and the last of several
    assert defect([A(ASK)], [U(ASK), A("Yes.")]) == "copies_prompt"
    assert defect([U("Hello there, my friend."), A("Hi."), U(ASK), A(ASK)], None) == "copies_prompt"
    assert defect([A("They like it.")], None) is None
    assert defect([U(None), A("They like it.")], [U(ASK), A(ASK)]) is None
    assert defect([U(ASK), A("It is good. " * 20000)], None) is None
    assert not is_refusal("") and not is_truncated("🙂", Rules())


def test_broken_pairs(spark):
    chat = "array<struct<role:string,content:string>>"
    rows = [(1, [U(ASK), A(ASK)], [U(ASK), A("Yes.")]), (1, [U(ASK), A(ASK)], [U(ASK), A("Yes.")]), (2, None, []), (None, None, None)]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], f"row_index bigint, chosen {chat}, rejected {chat}, side string, a int")
    got = sorted(tuple(r) for r in broken_pairs(df, "row_index").collect())
    assert got == [(1, "chosen", "copies_prompt"), (2, "chosen", "empty"), (2, "rejected", "empty")]
    assert broken_pairs(df.where("row_index > 9"), "row_index").count() == 0

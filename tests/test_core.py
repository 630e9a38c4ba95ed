"""Edge cases of the core functions and operators."""

from __future__ import annotations

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.functions import numbers as N
from weftline.functions import scoring as SC
from weftline.functions import text as T
from weftline.functions.expressions import same_value
from weftline.operators import control as C
from weftline.operators import decode as D
from weftline.operators import evaluation as E
from weftline.operators import metrics as M
from weftline.operators import prompts as P
from weftline.operators import sampling as SA
from weftline.operators import segments as S
from weftline.operators import tokenize as K
from weftline.operators.ranks import ranked
from weftline.sources import binidx, config, jsonl, subsets, vocab


def col(spark, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}")


def one(df, expr):
    return df.select(expr.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "given, want",
    [("a\r\n\r\nb", "a\nb"), ("a\rb", "a\rb"), ("\n\n\na\n\n", "a"), ("\xa0\x1c a \u3000", "a"), ("", ""), (" \r\n \r\n ", ""), ("x" * 100_000 + "\n\n", "x" * 100_000)],
)
def test_clean(spark, given, want):
    assert one(col(spark, given), T.clean_text(F.col("v"))) == want


@pytest.mark.parametrize(
    "given, want",
    [("<think>a</think>b", ("a", "b")), ("x<THINK >a\nb</think >c", ("a\nb", "c")), ("<think>1</think>2<think>3</think>4", ("1", "2<think>3</think>4")), ("<think>open", ("", "<think>open")), (None, ("", "")), ("<think></think>", ("", "")), ("plain", ("", "plain"))],
)
def test_think(spark, given, want):
    df = col(spark, given)
    assert (one(df, T.reasoning_of(F.col("v"))), one(df, T.answer_of(F.col("v")))) == want


def test_split_reasoning(spark):
    df = spark.createDataFrame([("a\n</think>\nb</think>c", True), ("cut", True), ("a</think>b", False), ("</think>", True)], "v string, t boolean")
    r, a = T.split_reasoning(F.col("v"), F.col("t"))
    assert [tuple(x) for x in df.select(r, a).collect()] == [("a", "b</think>c"), ("cut", ""), (None, "a</think>b"), ("", "")]


def conversation(spark, *turns):
    row = [(i, i, role, text) for i, (role, text) in enumerate(turns)]
    return spark.createDataFrame([(row,)], "messages array<struct<turn:int,message_id:bigint,role:string,content:string>>")


def flat(df, expr):
    return [(s["text"], s["lossable"]) for s in one(df, expr)]


def test_layouts(spark):
    chat = conversation(spark, ("user", "hi\r\n"), ("assistant", "<think>why</think>yes"), ("system", None))
    m = F.col("messages")
    assert flat(chat, S.chat_segments(m)) == [("System: You are a helpful assistant", False), ("\n\n", False), ("User: hi", False), ("\n\n", False), ("Assistant: <think></think>\n", False), ("<think>why</think>yes", True), ("\n\n", False), ("System: ", False)]
    assert flat(chat, S.reasoning_segments(m)) == [("System: You are a helpful assistant\n\n", False), ("User: hi", False), ("\n\n", False), ("Assistant: <think>", False), ("\nwhy\n</think>\nyes", True), ("\n\n", False), ("System: ", False)]
    led = conversation(spark, ("system", " be good "), ("assistant", "<think> \n </think>x"))
    assert flat(led, S.reasoning_segments(m)) == [("System: be good\n\n", False), ("Assistant: <think></think>\n", False), ("x", True)]
    assert one(led, S.flat_text(S.chat_segments(m))) == "System: be good\n\nAssistant: <think></think>\n<think> \n </think>x"
    pair = spark.createDataFrame([(None, "<think>r</think>a")], "i string, o string")
    assert flat(pair, S.pair_segments(F.col("i"), F.col("o"))) == [("System: You are a helpful assistant\n\n", False), ("User: \n\n", False), ("Assistant: <think>", False), ("\nr\n</think>\na", True)]


def test_unknown_role_is_an_error(spark):
    with pytest.raises(Exception, match="unknown role"):
        conversation(spark, ("user", "a"), ("tool", "b")).select(S.chat_segments(F.col("messages"))).collect()


def test_prompt(spark):
    df = conversation(spark, ("user", "a"), ("system", "s1"), ("system", "s2"), ("tool", "t"), ("assistant", "b"), ("user", "c"))
    assert one(df, S.prompt(F.col("messages"), F.lit("medium"))) == "System: s1\n\nUser: a\n\nAssistant: b\n\nUser: c\n\nAssistant: <think>"
    assert one(df, S.prompt(F.col("messages"), F.lit(None).cast("string"))).endswith("Assistant: <think></think>")
    assert one(conversation(spark, ("assistant", "b")), S.prompt(F.col("messages"), F.lit("minimal"))) is None
    assert one(conversation(spark), S.prompt(F.col("messages"), F.lit("minimal"))) is None


def test_scores(spark):
    def number(p, g):
        df = spark.createDataFrame([(p, g)], "p string, g string")
        return tuple(df.select(*SC.number_scores(F.col("p"), F.col("g")).values()).first())

    assert number("The answer is $1,000.. and 17", "1000") == (0.0, 0.0, 1.0)
    assert number("The answer is 1,000.", "1000") == (1.0, 1.0, 1.0)
    assert number("The answer is 1. The answer is 2", "1") == (1.0, 0.0, 1.0)
    assert number("it is 17", "7") == (0.0, 0.0, 0.0)
    assert number("", "") == (1.0, 1.0, 0.0) and number(None, "") == (1.0, 1.0, 0.0)
    assert one(col(spark, "a #### 1 #### $2,000. "), SC.number_gold(F.col("v"))) == "2000."

    def letter(p, g):
        df = spark.createDataFrame([(p, g)], "p string, g string")
        return tuple(df.select(*SC.letter_scores(F.col("p"), F.col("g")).values()).first())

    assert letter("is C.):]", "C") == (1.0, 1.0, 1.0)
    assert letter("\u00e9A is B. ATP (C)", "B") == (0.0, 0.0, 1.0)
    assert letter("", "") == (1.0, 1.0, 0.0)
    assert one(col(spark, "best answer is: (B) later A. stray"), SC.cascade_letter(F.col("v"))) == "A"
    assert one(col(spark, "none"), SC.cascade_letter(F.col("v"))) is None


@pytest.mark.parametrize("given, want", [("a \\boxed{x{y}z} b", "\\boxed{x{y}z}"), ("\\fbox{1}", "\\fbox{1}"), ("\\boxed 5$ x", "\\boxed 5"), ("\\boxed{open", None), ("none", None), (None, None), ("\\boxed{1} \\boxed{2}", "\\boxed{2}")])
def test_boxed(given, want):
    assert SC.boxed_span(given) == want


def test_unboxed(spark):
    assert one(col(spark, "\\boxed{a{b}}"), SC.unboxed(F.col("v"))) == "a{b}"
    assert one(col(spark, "\\boxed 5"), SC.unboxed(F.col("v"))) == "5"
    with pytest.raises(Exception, match="not boxed"):
        col(spark, "x").select(SC.unboxed(F.col("v"))).collect()


@pytest.mark.parametrize("given, want", [("x=\\frac12", "\\frac{1}{2}"), ("100,000", "100000"), ("\\text{5} dollars", "5"), ("\\sqrt3", "\\sqrt{3}"), ("$7$", "7"), ("1,a", "1,a")])
def test_final_answer(spark, given, want):
    assert one(col(spark, given), SC.final_answer(F.col("v"))) == want


@pytest.mark.parametrize(
    "a, b, same",
    [
        ("1", "1", True), (None, "1", False), ("1", "2", False), ("0.5", "\\frac12", True), ("\\frac{1}{2}", "1/2", True), ("x^2-1", "(x-1)(x+1)", True), ("x^2", "x^3", False), ("\\sqrt{8}", "2\\sqrt2", True), ("\\sqrt[3]{27}", "3", True),
        ("1,000", "1000", True), ("50\\%", "1/2", True), ("\\left(a+b\\right)^2", "a^2+2ab+b^2", True), ("2\\pi", "6.283", False), ("-3^2", "-9", True), ("1/0", "2", False), ("9^{9^9}", "1", False), ("(" * 5000, "1", False), ("north", "north", True), ("x y z \\foo", "1", False), ("", "", True), ("", "1", False), ("1/3", "0.3333333333", False),
    ],
)
def test_same_value(a, b, same):
    assert same_value(a, b) is same


def test_named_choice(spark):
    rows = [("It is (B) or (C)", ["x", "y", "z"], "(C)"), ("first RED, then blue", ["Blue", "red", None], "(A)"), ("blue, then red", ["Blue", "red", ""], "(B)"), ("nothing", ["Blue"], ""), (None, ["Blue"], ""), ("x", None, "")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, p string, c array<string>, want string")
    assert all(r["got"] == r["want"] for r in df.select("want", SC.bracketed_or_named_choice(F.col("p"), F.col("c")).alias("got")).collect())


def test_intermediate_folders(spark):
    import os

    from weftline import session

    assert session.default_dir("local[4]").startswith("file:") and session.default_dir("local").startswith("file:")
    for master in ("spark://host:7077", "yarn", "k8s://https://host", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError, match="checkpoint"):
            session.default_dir(master)
    folder = session.shared_dir(spark).removeprefix("file://").removeprefix("file:")
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    with session.workspace(spark):
        assert session.staged(spark.range(10), "gone").count() == 10
        assert set(os.listdir(folder)) - before
    assert set(os.listdir(folder)) == before


def test_hooks(spark):
    from weftline.operators import hooks

    with pytest.raises(ValueError, match="unknown"):
        hooks.task("none")
    with pytest.raises(ValueError, match="already"):
        hooks.register("letter", hooks.TASKS["letter"])
    docs = spark.createDataFrame([(1, "How many?", "so #### 7"), (2, "No solution", None)], "item_id int, question string, solution string")
    answers = spark.createDataFrame([(10, 1, "#### 7."), (11, 1, None), (12, 2, "7")], "response_id int, item_id int, response string")
    got = {(r["response_id"], r["metric"]): r["value"] for r in hooks.scored("number", docs, answers, "item_id").collect()}
    assert got == {(10, m): 1.0 for m in ("exact", "flexible", "loose")} | {(11, m): 0.0 for m in ("exact", "flexible", "loose")}


def test_prefetch(spark):
    rows = [("a", "p/a", "x", False, True), ("a", "p/a", None, False, False), ("g", "p/g", "m", True, False)]
    df = spark.createDataFrame(rows, "name string, path string, config string, gated boolean, ok boolean")
    assert [tuple(r) for r in C.prefetch_plan(df, ["g"], True).select("name", "action").collect()] == [("g", "skip")]
    assert {r["action"] for r in C.prefetch_plan(df).collect()} == {"fetch"}
    assert tuple(C.prefetch_outcome(df).first()) == (["p/a:None", "p/g:m"], 1)
    assert tuple(C.prefetch_outcome(df.where("gated")).first()) == (["p/g:m"], 0) and tuple(C.prefetch_outcome(df.where("ok")).first()) == ([], 0)


def test_combined(spark):
    held = spark.createDataFrame([("a", 1), ("b", None), ("c", 3)], "k string, v int")
    wanted = spark.createDataFrame([("a",), ("b",)], "k string")
    assert {tuple(r) for r in C.combined(wanted, held, "k", "v").collect()} == {("a", 1), ("b", None)}
    with pytest.raises(Exception, match="nothing is held for x"):
        C.combined(spark.createDataFrame([("x",)], "k string"), held, "k", "v").collect()


def test_placeholders():
    assert config.materialized("k: __PASS_K__, __PASS_K__", PASS_K=3) == "k: 3, 3"
    with pytest.raises(ValueError, match="__OTHER__"):
        config.materialized("__PASS_K__ __OTHER__", PASS_K=1)


def test_prompt_texts(spark):
    df = spark.createDataFrame([(" q ", ["a", None, "c"])], "q string, c array<string>")
    text = one(df, P.best_of_four(F.col("q"), F.col("c")))
    assert "Question: q\nA. a\nB. \nC. c\nYour response" in text and "D. " not in text.split("Your response")[0]
    assert one(col(spark, None), P.tidy_choice(F.col("v"))) == " "
    assert one(col(spark, " a  b    c [title]d "), P.tidy_choice(F.col("v"))) == "a b  c. d"
    passage = spark.createDataFrame([("art", "[{'question':'x','options':['1','2','3','4'],'answer':'A'},{'question':' y ','options':['p','q','r','s'],'answer':'B'}]")], "a string, p string")
    assert "Question: y\nA. p\nB. q\nC. r\nD. s\n" in one(passage, P.passage_prompt(F.col("a"), F.col("p")))


def test_magic_primes():
    for bad in (100, *range(126, 131), 166, *range(219, 227)):
        with pytest.raises(ValueError):
            N.magic_prime(bad)
    assert [N.magic_prime(s) for s in (101, 1000, 60000, 2926223, 81082843)] == [101, 983, 59999, 2926181, 81082817]
    with pytest.raises(ValueError):
        N.check_prime(983, 1000)
    assert N.check_prime(59999, 60000) and not N.check_prime(59999, 80000)


@pytest.mark.parametrize("p", [101, 983])
def test_slots_are_a_permutation(spark, p):
    got = [r[0] for r in spark.range(1, p + 1).select(N.slot(F.col("id"), p)).collect()]
    assert sorted(got) == list(range(p))
    assert got == [N.slot_factor(p) * i**3 % p for i in range(1, p + 1)]


def test_uniform(spark):
    got = [r[0] for r in spark.range(1000).select(N.uniform(F.col("id"), 3, F.col("id") % 7, 5)).collect()]
    want = N.uniform_array(np.arange(1000), 3, np.arange(1000) % 7, 5)
    assert np.allclose(got, want, atol=0) and 0.45 < want.mean() < 0.55


def test_samples(spark):
    docs = spark.createDataFrame([(1, [5] * 10 + [0], [1] * 10), (2, [7] * 100, [0] * 100), (3, [], [])], "doc_id bigint, tokens array<int>, lossable array<tinyint>")
    rows = {r["doc_id"]: r for r in SA.assemble(docs, 100, 8).collect()}
    raw = SA.raw_length(100, 8)
    assert raw == 32
    for r in rows.values():
        assert len(r["x"]) == len(r["y"]) == 100
        x, y, m = np.array(r["x"]), np.array(r["y"]), np.array(r["masked"])
        b = x[:96].reshape(4, 3, 8)
        assert (b[:, 0] == b[:, 1]).all() and (x[96:] == 65534).all()
        clean = b[:, 2].reshape(-1)
        assert (np.where(m, 65535, clean) == b[:, 0].reshape(-1)).all()
        t = y[:96].reshape(4, 3, 8)
        assert (t[:, 0] == -100).all() and (t[:, 2] == -100).all()
        assert ((t[:, 1].reshape(-1) != -100) == (m & (clean != 65534))).all()
    assert rows[1]["masked"][10] and all(rows[1]["masked"][11:16]) and not any(rows[1]["masked"][16:])
    assert not any(rows[2]["masked"]) and set(rows[3]["y"]) == {-100}


def test_samples_of_whole_documents(spark, sf_dir):
    """No token is cut or left out, and blocks that a fixed context has too are equal."""
    docs = spark.createDataFrame([(1, [5] * 10 + [0], [1] * 10 + [0]), (2, [7] * 999 + [0], [1] * 999 + [0]), (3, [], []), (4, [9] * 15 + [0], [0] * 16)], "doc_id bigint, tokens array<int>, lossable array<tinyint>")
    whole = {r["doc_id"]: r for r in SA.assemble(docs, None, 8).collect()}
    assert {i: len(r["masked"]) for i, r in whole.items()} == {1: 16, 2: 1000, 3: 0, 4: 16}
    assert all(len(r["x"]) == len(r["y"]) == 3 * len(r["masked"]) for r in whole.values())
    clean = np.array(whole[2]["x"]).reshape(-1, 3, 8)[:, 2].reshape(-1)
    assert clean.tolist() == [7] * 999 + [0] and whole[2]["masked"][-1] and whole[2]["y"][-9] == 0
    for r in SA.assemble(docs, 100, 8).collect():
        n = min(32, len(whole[r["doc_id"]]["masked"]))
        assert all(r[c][: k * n] == whole[r["doc_id"]][c][: k * n] for c, k in (("masked", 1), ("x", 3), ("y", 3)))
    sums = SA.block_sums(docs, 8).collect()
    assert len(sums) == 2 + 125 + 2 and sum(r["total"] for r in sums if r["doc_id"] == 2) == 7 * 999

    from weftline.plans import sampling as PS

    texts = dict(spark.read.parquet(f"{sf_dir}/documents.parquet").where("text <> ''").select("doc_id", "text").collect())
    got = PS.eos_blocks_whole(spark, sf_dir).collect()
    assert len(got) == sum(len(t) // 32 + 1 for t in texts.values()) and max(len(t) for t in texts.values()) > 2048
    assert {(r["doc_id"], r["block"]) for r in got if r["has_eos"]} == {(i, len(t) // 32) for i, t in texts.items()}
    assert sorted(PS.whole_streams(spark, sf_dir).collect()) == sorted((i, t, [*loss, 0]) for i, t, loss in PS.char_streams(spark, sf_dir).collect())


def test_flat_windows(spark):
    sizes = [3, 50, 1, 200, 7]
    df = spark.createDataFrame(list(enumerate(sizes)), "doc_id bigint, size bigint")
    got = {(r["win"], r["doc_id"]): (r["doc_from"], r["doc_to"]) for r in SA.flat_window_parts(df, 16).collect()}
    start, want = 0, {}
    for d, s in enumerate(sizes):
        for w in range(sum(sizes) // 16):
            lo, hi = max(start, w * 16), min(start + s, w * 16 + 17)
            if lo < hi:
                want[w, d] = (lo - start, hi - start)
        start += s
    assert got == want


def test_ranks_of_a_hot_group(spark):
    df = spark.range(1000).select((F.col("id") % 10 == 0).cast("int").alias("k"), "id", (F.col("id") % 5).alias("n"))
    rows = ranked(df.repartition(7), ["k"], ["id"], total=F.col("n")).collect()
    for k in (0, 1):
        mine = sorted((r["id"], r["rank"], r["before"]) for r in rows if r["k"] == k)
        assert [r[1] for r in mine] == list(range(len(mine)))
        assert [r[2] for r in mine] == np.concatenate([[0], np.cumsum([r[0] % 5 for r in mine])[:-1]]).tolist()


def test_tokenizers_agree(spark, sf_dir):
    pieces = ["the", "th", "t", "ing", "."]
    words = vocab.byte_vocab(pieces)
    texts = [r[0] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").where("text <> ''").select("text").collect()]
    trie = K.Trie(words)
    df = spark.createDataFrame([(t,) for t in texts], "v string").select("v", K.cut(F.col("v"), pieces).alias("c"))
    for r in df.collect():
        want = [words[i] for i in trie.encode(r["v"].encode())]
        got = [b for c in r["c"] for b in ([c.encode()] if c in pieces else [bytes([x]) for x in c.encode()])]
        assert got == want
        assert K.decode_ids(trie.encode(r["v"].encode()), words) == r["v"]
        assert K.Table(words).encode(r["v"].encode()) == trie.encode(r["v"].encode())
    for kind in (K.Trie, K.Table):
        with pytest.raises(ValueError):
            kind({1: b"a"}).encode(b"ab")


@pytest.mark.parametrize("seed", range(6))
def test_native_tokenizer_equals_trie(seed):
    import random

    rng = random.Random(seed)
    pieces = {bytes(rng.choices(b"abc\xc3\xa9", k=rng.randint(2, 7))) for _ in range(rng.choice([3, 40, 400]))}
    words = vocab.byte_vocab() | {300 + i: p for i, p in enumerate(sorted(pieces))}
    native, plain = K.Trie(words), K.Trie(words, native=False)
    for _ in range(300):
        data = bytes(rng.choices(b"abc\xc3\xa9d", k=rng.randint(0, 60)))
        assert native.encode(data) == plain.encode(data)


def test_safe_decode():
    words = vocab.byte_vocab()
    e = [b + 1 for b in "\u00e9".encode()]
    assert K.safe_decode_ids([98, 65534, 99, 65535], words) == "ab"
    assert K.safe_decode_ids([98, e[0]], words) == "a<undecodable tail x1>"
    assert K.safe_decode_ids([65534, 98, e[0], 65535, 99], words) == "<65534>a<undecodable tail x1><65535>b"
    assert K.emitted_ids([98, *e, 99], words) == ["a", "", "\u00e9", "b"]


def test_vocab_lines():
    for token in ("the", "\u00e9", "'\"\n"):
        assert vocab.parse_line(vocab.format_line(7, token.encode())) == (7, token.encode())
    assert vocab.parse_line(vocab.format_line(7, b"\xff ")) == (7, b"\xff ")
    with pytest.raises(ValueError):
        vocab.parse_line("1 'ab' 3")
    with pytest.raises((ValueError, SyntaxError)):
        vocab.parse_line("1 __import__('os') 3")


def test_token_streams(spark):
    rows = [([("ab", True), ("", True), ("c", False)],), ([],), (None,)]
    df = spark.createDataFrame(rows, "segments array<struct<text:string,lossable:boolean>>")
    got = [(r["tokens"], r["lossable"]) for r in K.token_streams(df, "segments", vocab.byte_vocab()).collect()]
    assert got == [([98, 99, 100, 0], [1, 1, 0, 0]), ([0], [0]), ([0], [0])]


def test_store_slice_is_not_empty(spark, sf_dir):
    from weftline.plans import control

    got = sorted(r["doc_id"] for r in control.store_slice(spark, sf_dir).collect())
    assert len(got) > 4 and got == list(range(got[0], got[-1] + 1)) and got[0] > 0


STORED = "doc_order bigint, tokens array<int>, lossable array<tinyint>"


def test_shards(spark, tmp_path):
    """A store of several shards reads as one set of files does, and joins into it."""
    docs = [(i, list(range(1000 * i, 1000 * i + i % 7)), [j % 2 for j in range(i % 7)]) for i in range(200)]
    kept = [d for d in docs if d[1]]
    path = str(tmp_path / "many")
    (tmp_path / "many").mkdir()
    (tmp_path / "many" / "shard-00000000-999.bin").write_bytes(b"left by an attempt that failed")
    listed = binidx.write_shards(spark.createDataFrame(docs, STORED), path, partitions=5)
    assert sorted(p.name for p in (tmp_path / "many").iterdir()) == sorted([*(s["name"] + e for s in listed for e in (".bin", ".idx", ".lossable.bin")), "manifest.json"])
    assert len(listed) > 1 and sum(s["docs"] for s in listed) == len(kept)
    binidx.export(path, f"{path}/all")
    whole, single = sorted(binidx.read(spark, path).collect()), sorted(binidx.read(spark, f"{path}/all").collect())
    assert whole == single and [r["tokens"] for r in whole] == [d[1] for d in kept]
    stream = [t for d in kept for t in d[1]]
    assert binidx.flat(path, 3, 400).tolist() == stream[3:403]
    starts = np.cumsum([0, *(len(d[1]) for d in kept)]).tolist()
    wanted = [(i, i % 3, n) for i in (0, 7, 90) for n in (None, 0, 1, 3)] + [(len(kept) - 1, 1, None), (5, 0, 300)]
    got = {(r["idx"], r["offset"], r["length"]): r["tokens"] for r in binidx.get(spark.createDataFrame(wanted, "idx bigint, offset bigint, length bigint"), path).collect()}
    for (i, offset, n), tokens in got.items():
        end = starts[i] + offset + n if n is not None else max(starts[i] + offset, starts[i + 1])
        assert tokens == stream[starts[i] + offset : end]
    for bad in ((len(kept), 0, 1), (-1, 0, 1), (0, 0, len(stream) + 1)):
        with pytest.raises(Exception, match="no document|stream ends"):
            binidx.get(spark.createDataFrame([bad], "idx bigint, offset bigint, length bigint"), path).collect()


def test_conditions_narrow_the_ranges(spark, tmp_path):
    path = str(tmp_path / "narrow")
    binidx.write_shards(spark.createDataFrame([(i, [i], [1]) for i in range(100)], STORED), path, partitions=4)
    from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, In, LessThan

    for filters, want in ([EqualTo(("doc_id",), 42)], {42}), ([GreaterThanOrEqual(("doc_id",), 10), LessThan(("doc_id",), 12)], {10, 11}), ([In(("doc_id",), (3, 5))], {3, 4, 5}), ([EqualTo(("size",), 1)], set(range(100))):
        reader = binidx.Reader(path, "all", 7)
        assert list(reader.pushFilters(filters)) == filters
        assert {i for p in reader.partitions() for i in range(p.shard.first_doc + p.lo, p.shard.first_doc + p.hi)} == want
    assert [r["tokens"] for r in binidx.at(binidx.read(spark, path), 42).collect()] == [[42]]
    assert binidx.at(binidx.read(spark, path), 1000).count() == 0


def test_torn_stream(spark, tmp_path):
    prefix = str(tmp_path / "torn")
    binidx.write(spark.createDataFrame([(0, [1, 2], [1, 1])], STORED), prefix)
    (tmp_path / "torn.bin").write_bytes(b"\0" * 7)
    with pytest.raises(ValueError, match="torn"):
        binidx.tokens_by_file(prefix)


def test_binidx_round_trip(spark, tmp_path):
    docs = [(i, list(range(1, 1 + i * 3)), [j % 2 for j in range(i * 3)]) for i in range(7)]
    df = spark.createDataFrame(docs[::-1], "doc_order bigint, tokens array<int>, lossable array<tinyint>")
    prefix = str(tmp_path / "s")
    binidx.write(df, prefix)
    kept = [d for d in docs if d[1]]
    got = sorted(binidx.read(spark, prefix).collect())
    assert [(r["tokens"], r["lossable"]) for r in got] == [(d[1], d[2]) for d in kept]
    assert [r["size"] for r in sorted(binidx.read(spark, prefix, "sizes").collect())] == [len(d[1]) for d in kept]
    assert binidx.exists(prefix) and binidx.tokens_by_file(prefix) == sum(len(d[1]) for d in kept)
    assert binidx.flat(prefix, 2, 5).tolist() == [3, 1, 2, 3, 4]
    head = (tmp_path / "s.idx").read_bytes()
    n = len(kept)
    sizes = [len(d[1]) for d in kept]
    want = b"MMIDIDX\x00\x00" + struct.pack("<QBQQ", 1, 4, n, n + 1) + struct.pack(f"<{n}i", *sizes) + struct.pack(f"<{n}q", *(4 * int(x) for x in np.cumsum([0, *sizes[:-1]]))) + struct.pack(f"<{n + 1}q", *range(n + 1))
    assert head == want
    (tmp_path / "s.lossable.bin").unlink()
    assert all(set(r["lossable"]) == {1} for r in binidx.read(spark, prefix).collect())
    with pytest.raises(ValueError):
        binidx.contiguous(binidx.read(spark, prefix), 0, 2, 2)


@pytest.mark.parametrize("broken", [b"", b"WRONG" * 10, b"MMIDIDX\x00\x00" + struct.pack("<QBQQ", 2, 4, 0, 1), b"MMIDIDX\x00\x00" + struct.pack("<QBQQ", 1, 6, 0, 1)])
def test_binidx_errors(tmp_path, broken):
    (tmp_path / "b.idx").write_bytes(broken)
    with pytest.raises(ValueError):
        binidx.header(str(tmp_path / "b"))


def test_binidx_sidecar_must_fit(spark, tmp_path):
    df = spark.createDataFrame([(0, [1, 2], [1, 1])], "doc_order bigint, tokens array<int>, lossable array<tinyint>")
    prefix = str(tmp_path / "t")
    binidx.write(df, prefix)
    (tmp_path / "t.lossable.bin").write_bytes(b"\x01")
    with pytest.raises(Exception, match="number of tokens"):
        binidx.read(spark, prefix).collect()


def test_sidecar_bits_pass_the_driver_in_blocks(spark, tmp_path, monkeypatch):
    """A stream of 3 million tokens takes the driver no more than a few blocks, not a copy of its bits."""
    import tracemalloc

    from weftline.plans import store

    n = 3_000_000
    spark.createDataFrame([(i, "aB" * (n // 20)) for i in range(10)], "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    monkeypatch.setattr(binidx, "_COPY", 1 << 16)
    tracemalloc.start()
    try:
        df = store.sidecar(spark, str(tmp_path))
        assert tracemalloc.get_traced_memory()[1] < n / 2
    finally:
        tracemalloc.stop()
    got = {r["sidecar"]: r["n"] for r in df.groupBy("sidecar").agg(F.sum("n_lossable").alias("n")).collect()}
    assert got == {"own": n // 2, "longer name": 0, "none": n}


def test_fill(tmp_path, monkeypatch):
    monkeypatch.setattr(binidx, "_COPY", 4)
    for n in (0, 3, 4, 9):
        binidx.fill(str(tmp_path / "f"), 7, n)
        assert (tmp_path / "f").read_bytes() == b"\x07" * n


def test_empty_store(spark, tmp_path):
    prefix = str(tmp_path / "e")
    binidx.write(spark.createDataFrame([], "doc_order bigint, tokens array<int>, lossable array<tinyint>"), prefix)
    assert binidx.header(prefix) == (4, 0, 1) and binidx.read(spark, prefix).count() == 0


def test_variants(spark, tmp_path):
    (tmp_path / "code_train.jsonl").write_text('{"text": "c"}\n')
    (tmp_path / "own.jsonl").write_text('{"text": "o"}\n')
    read = lambda *a: [r["text"] for r in subsets.read_variant(spark, str(tmp_path), "text string", *a).collect()]
    assert read("code") == ["c"] and read("code", "own.jsonl") == ["o"] and read("unknown", "own.jsonl") == ["o"]


def test_jsonl(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"text": "old"}\n\n{"segments": [{"text": "x", "lossable": true}, {"lossable": true}]}\n')
    got = [[tuple(s) for s in r["segments"]] for r in jsonl.read(spark, str(tmp_path / "a.jsonl")).collect()]
    assert got == [[("old", True)], [("x", True), ("", True)]]
    (tmp_path / "b.jsonl").write_text('{"other": 1}\n')
    with pytest.raises(Exception, match="neither"):
        jsonl.read(spark, str(tmp_path / "b.jsonl")).collect()
    (tmp_path / "c.jsonl").write_text("{broken\n")
    with pytest.raises(Exception):
        jsonl.read(spark, str(tmp_path / "c.jsonl")).collect()
    with pytest.raises(ValueError):
        subsets.read_variant(spark, "x", "text string", "unknown")


def test_config():
    rows = config.task_rows("tasks:\n  a:\n    num_fewshot: 3\n    gen_kwargs:\n      t: 0.5\n  b:\n    unsafe_code: true\n")
    assert rows == [("a", 3, False, False, None, {"t": "0.5"}), ("b", None, True, False, None, {})]
    with pytest.raises(ValueError):
        config.task_rows("tasks:\n  a:\n    gen_kwargs:\n      t: 'x y'\n")


def test_results(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "r.json").write_text('{\n  "results": {\n    "task": {"exact": "0.5"}\n  }\n}\n')
    (tmp_path / "t" / "bad.json").write_text("{nothing")
    (tmp_path / "summary.json").write_text("{}")
    got = {r["path"].rsplit("/", 1)[1]: (r["results"], r["error"]) for r in config.read_results(spark, str(tmp_path)).collect()}
    assert got["r.json"] == ({"task": {"exact": "0.5"}}, None) and got["bad.json"][1] == "unreadable" and len(got) == 2


def test_pass_at_k(spark):
    df = spark.createDataFrame([(5, 0), (5, 5), (5, 2), (3, 2)], "n bigint, c bigint")
    got = [r[0] for r in df.select(E.pass_at_k(F.col("n"), F.col("c"), 2)).collect()]
    assert np.allclose(got, [0.0, 1.0, 1 - 3 / 10, 1.0])


def test_rollup_is_weighted(spark):
    leaves = spark.createDataFrame([("m", "g", "s", "a", 1, 1.0), ("m", "g", "s", "b", 3, 0.0), ("m", "g", "t", "c", 4, None)], "metric string, grp string, subgroup string, task string, n bigint, value double")
    top = E.weighted_rollup(leaves, ["grp", "subgroup", "task"]).where("level = 3").first()
    assert (top["n"], top["value"]) == (4, 0.25)


def test_few_shot_without_demos(spark):
    docs = spark.createDataFrame([(1, "a", "q")], "id bigint, task string, q string")
    assert E.few_shot(docs, docs.where("false"), "task", "id", "q", 2).first()["prompt"] == "q"


def test_decode(spark):
    rows = spark.createDataFrame([(0, t, z) for t, z in enumerate([5.0, 5.0, 5.0, 1.0])], "k int, token int, logit double")
    assert D.top_k(rows, ["k"], 1).count() == 3
    probs = D.softmax(rows, ["k"], temperature=0.0)
    assert abs(probs.agg(F.sum("prob")).first()[0] - 1) < 1e-9
    sharp = spark.createDataFrame([(0, 0, 0.9), (0, 1, 0.1)], "k int, token int, prob double")
    assert [r["token"] for r in D.nucleus(sharp, ["k"], 0.5).collect()] == [0]
    t, f = D.truncated(F.col("v"), 2)
    df = spark.createDataFrame([([5, 0, 7],), ([1, 2, 3],), ([0],), ([],)], "v array<int>")
    assert [tuple(r) for r in df.select(t, f).collect()] == [([5], "stop"), ([1, 2], "length"), ([], "stop"), ([], "length")]
    pos = spark.createDataFrame([(0, i, 0.1 * i, i != 3) for i in range(4)], "b int, pos int, confidence double, is_masked boolean")
    assert sorted(r["pos"] for r in D.committed(pos, ["b"], 0.9, 2, 4).where("commit").collect()) == [1, 2]
    assert sorted(r["pos"] for r in D.committed(pos, ["b"], 0.05, 2, 4).where("commit").collect()) == [1, 2]


def test_metrics(spark):
    names = spark.createDataFrame([("m-3.pth",), ("m-init.pth",), ("m-final.pth",), ("m-12.pth",)], "n string")
    assert tuple(M.latest_two(names, "n").first()) == (12, 3)
    runs = spark.createDataFrame([(1, "stage_2", 4, False), (2, "stage_3", 8, True), (3, "stage_2", 8, False), (4, "stage_3", 9, True), (5, "stage_2_offload", 8, False)], "seq int, strategy string, batch int, oom boolean")
    assert [r["skipped"] for r in M.oom_frontier(runs).orderBy("seq").collect()] == [False, False, True, False, False]


def test_control(spark):
    a = spark.createDataFrame([({"a": "1", "b": "2"}, {"b": "3"})], "g map<string,string>, o map<string,string>")
    assert one(a, C.overridden(F.col("g"), F.col("o"))) == {"a": "1", "b": "3"}
    with pytest.raises(Exception, match="unknown preset"):
        C.presets(spark.createDataFrame([("x",)], "name string"), ["y"]).collect()
    tasks = spark.createDataFrame([("a",), ("b",)], "task string")
    assert C.selected(tasks, "").count() == 2 and C.selected(tasks, "b, c").count() == 1


def test_stream_resumes(spark, tmp_path):
    from weftline.streaming.ingest import ingest

    src = tmp_path / "in"
    src.mkdir()
    args = (str(src), str(tmp_path / "out"), str(tmp_path / "cp"))
    (src / "1.jsonl").write_text('{"text": "a"}\n')
    ingest(spark, *args).awaitTermination()
    (src / "2.jsonl").write_text('{"text": "b"}\n\n')
    ingest(spark, *args).awaitTermination()
    assert spark.read.parquet(args[1]).count() == 2

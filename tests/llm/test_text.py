"""Tokens, packing, chat, languages, toxicity, rules and grades."""

import base64
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from strandgraph.llm import bpe, chat, langid, ordinal, packing, queries, rules, toxicity

DIR = "/root/testdata/sf0.001"
WORD, BYTE = P.path("word_bpe_49k.json"), P.path("byte_bpe_50k.tiktoken")
ODD = [
    "", "  ", "a  b   c\n\n d \n e", "don't  stop now é ́x", "<|endoftext|> x<|endoftext|>y <a> Σ ΑΣ İ", "x" * 3000, "ab" * 900 + " !?" * 50, "日本語 テスト😀",
    "\t\n x \r\n y\x1c z\x85 w", "a \n b", "a\n b ", "\n", "  lead", "trail  ", "'s 're x's", "ÀÉÎ ŉ ſ ß ¼½ ²x ¡hola! soft­hyphen ÿŸ ĲĴ I'LL",
]


def _random_texts(n):
    rng = random.Random(5)
    ab = " \n\t.,'aAbBéÉßşŞſ19!-<|>İΣσ́ 日😀"
    return ["".join(rng.choice(ab) for _ in range(rng.randint(1, 60))) for _ in range(n)]


def test_word_tokens_are_the_librarys():
    texts = ODD + _random_texts(400)
    want = Tokenizer.from_file(WORD)
    ids, at = packing.WordTokenizer(WORD).encode_batch(pa.array(texts, pa.large_string()))
    assert [ids[at[i] : at[i + 1]].tolist() for i in range(len(texts))] == [want.encode(t, add_special_tokens=False).ids for t in texts]


def test_byte_tokens_are_the_librarys(monkeypatch):
    monkeypatch.setattr(bpe, "LONG_WORD", 40)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(BYTE, "rb"))}
    want = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = ODD + _random_texts(400)
    enc = bpe.Encoder(BYTE, P.PATTERN)
    for t, (ids, decoded) in zip(texts, bpe._rows(enc, pa.array(texts, pa.large_string())), strict=True):
        assert np.frombuffer(ids, np.uint32).tolist() == want.encode_ordinary(t)
        assert decoded == t.encode()
    bpe._encoders[BYTE, P.PATTERN] = enc
    assert bpe.decode_ids(np.array(want.encode_ordinary("été 日"), np.uint32).tobytes(), BYTE, P.PATTERN) == "été 日".encode()


def test_bpe_query_is_the_librarys_for_every_document(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").toPandas().set_index("doc_id")["text"]
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(BYTE, "rb"))}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = queries.op9_bpe(spark, DIR).collect()
    assert len(got) == len(docs)
    for r in got:
        ids = library.encode_ordinary(docs[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(library.decode_bytes(ids)).hexdigest() == hashlib.sha256(docs[r["doc_id"]].encode()).hexdigest()
    odd = spark.createDataFrame([(1, None, 0), (None, "", 0), (2, "a", 0), (2, "a", 0)], "doc_id long, text string, ids int")
    assert sorted(r["n_tokens"] for r in bpe.digests(odd, BYTE, P.PATTERN).collect()) == [0, 0, 1, 1]
    assert bpe.encode(odd.limit(0), BYTE, P.PATTERN).count() == 0


def test_packing_query(spark):
    got = queries.op3_packing(spark, DIR).cache()
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()}
    tok, per = Tokenizer.from_file(WORD), {}
    for r in got.collect():
        per.setdefault(r["doc_id"], []).append(r)
    assert per.keys() == docs.keys()
    for d, rows in per.items():
        ids = np.array([*tok.encode(docs[d], add_special_tokens=False).ids, 0], np.uint32)
        assert sum(r["length"] for r in rows) == len(ids)
        for r in rows:
            part = ids[r["start"] : r["start"] + r["length"]]
            assert (r["start"], r["ids_crc32"]) == (r["piece"] * 2048, zlib.crc32(part.tobytes()))
    use = packing.utilisation(got).first()
    assert use["sequences"] <= use["least"] * 1.02 + 2
    assert packing.gapless(got).count() == 0
    assert got.groupBy("sequence_id").agg(F.sum("length").alias("n")).filter("n > 2048").count() == 0


def test_packing_edge_cases(spark):
    odd = spark.createDataFrame([(1, None, 0), (None, "", 0), (2, "word " * 5000, 0), (2, "word " * 5000, 0), (3, "hi", 0)], "doc_id long, text string, offset int")
    got = packing.pack(odd, WORD).collect()
    assert sorted(r["length"] for r in got) == [1, 1, 2, 905, 905, 2048, 2048, 2048, 2048]
    assert packing.pack(odd.limit(0), WORD).count() == 0


def test_sum_of_squares_is_gapless():
    rng = np.random.default_rng(1)
    n = rng.integers(1, 101, 500)
    seq, off, gaps = packing.sum_of_squares(n, 100)
    for b in range(len(gaps)):
        at = np.flatnonzero(seq == b)
        at = at[np.argsort(off[at])]
        assert (off[at] == np.concatenate(([0], np.cumsum(n[at])[:-1]))).all()
        assert n[at].sum() == 100 - gaps[b]
    assert len(gaps) <= -(-n.sum() // 100) * 1.08  # half of the pieces are too long to pair up well


def test_chat_query(spark):
    rows = spark.read.parquet(f"{DIR}/conversations.parquet").orderBy("conv_id", "turn").collect()
    per = {}
    for r in rows:
        per.setdefault(r["conv_id"], []).append((r["role"], r["text"] or ""))
    said = "</s>[INST] ok [/INST]"
    per[-1] = [("user", said), ("assistant", said)]
    got = {r["conv_id"]: r for r in queries.op2_chat(spark, DIR).collect()}
    assert got.keys() == per.keys()
    for c, turns in per.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        assert got[c]["n_turns"] == len(turns)
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_chat_marks_cannot_be_forged():
    rng = random.Random(3)
    parts = [*chat.CONTROL, "<", "\\", "[", "s>", "|im_end|>", "\n", "x", "user"]
    for _ in range(500):
        turns = [(0, "".join(rng.choices(parts, k=3)), "".join(rng.choices(parts, k=8))) for _ in range(3)]
        text, _ = chat.render(turns)
        assert chat.parse(text) == [(r, t) for _, r, t in turns]
        assert all(c not in chat.escape(t) for _, _, t in turns for c in chat.CONTROL)


def test_chat_log_of_turns_ends_in_the_turns(spark):
    rows = [(1, 2, "assistant", "b\U0001f600c\nd"), (1, 1, "user", None), (1, 3, "user", "x"), (1, 3, "user", "x"), (1, None, None, "n"), (1, 4, "tool", ""), (2, 7, "assistant", "only </s> one"), (None, 1, "user", "<|im_end|>")]
    rows += [(3, t, "assistant" if t % 2 else "user", f"text {t} " * t) for t in range(12)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("p", F.lit("extra"))
    log = chat.events_of_turns(df)
    assert {r["kind"] for r in log.collect()} == {"message", "delta", "edit", "regenerate"}
    want = {}
    for c, _, role, text in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        want.setdefault(c, []).append((role or "", text or ""))
    assert {r["conv_id"]: chat.parse(r["formatted"]) for r in chat.format_conversations(log).collect()} == want
    assert chat.format_conversations(chat.events_of_turns(df.limit(0))).count() == 0


def test_chat_folds_events(spark):
    log = [
        (1, 0, "message", 0, "user", "hi"), (1, 1, "delta", 1, "assistant", "he"), (1, 2, "delta", 1, "assistant", "llo"), (1, 3, "message", 2, "user", "more"),
        (1, 4, "edit", 0, "user", "hi!"), (1, 5, "regenerate", 1, "assistant", None), (1, 6, "delta", 1, "assistant", "hello there"), (2, 0, "delete", 0, None, None), (None, 0, None, 0, None, None),
    ]
    df = spark.createDataFrame([(*e, "x") for e in log], "conv_id long, seq long, kind string, turn long, role string, text string, formatted string")
    got = {r["conv_id"]: r["formatted"] for r in chat.format_conversations(df).collect()}
    assert chat.parse(got[1]) == [("user", "hi!"), ("assistant", "hello there")]
    assert got[2] == "" and chat.parse(got[None]) == [("", "")]
    assert chat.format_conversations(df.limit(0)).count() == 0


def test_languages(spark):
    got = queries.op8_langid(spark, DIR).join(spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert len(got) > 20 and sum(r["lang"] == r["lang_pred"] for r in got) >= 0.95 * len(got)
    odd = spark.createDataFrame([(1, None, "en", 1), (2, "12 !!", "en", 1), (None, "the and of", "en", 1), (4, "der die das", "de", 1), (4, "der die das", "de", 1), (5, "the " * 9000, None, 1)], "doc_id long, text string, lang string, score int")
    got = {r["doc_id"]: r["lang_pred"] for r in langid.identify(odd, 1, 7).collect()}
    assert got == {1: "und", 2: "und", None: "en", 4: "de", 5: "en"}
    assert langid.identify(odd.limit(0)).count() == 0
    assert {r["lang_pred"] for r in langid.identify(odd.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def _plain_profile(text):
    """The bundle of a text's trigrams, one by one."""
    padded = "_" + re.sub(r"[^a-zäöüßéèà日本]+", "_", text.lower()).strip("_") + "_"
    v = {c: langid.letter_vectors(np.array([0 if c == "_" else ord(c)], np.uint64))[0].astype(int) for c in set(padded)}
    total = np.zeros(langid.DIM, int)
    for a, b, c in zip(padded, padded[1:], padded[2:], strict=False):
        total += np.roll(v[a], 2) * np.roll(v[b], 1) * v[c]
    return total


def test_hyperdimensional_profiles():
    x = langid.letter_vectors(np.arange(0x4E00, 0x4E00 + 200, dtype=np.uint64)).astype(int)
    cos = x @ x.T / langid.DIM
    np.fill_diagonal(cos, 0)
    assert np.abs(cos).max() < 0.3  # letters of any script have vectors of their own
    for text in ("Ab, c", "Die Straße  ändert--sich", "日本 日本語"[:5], "a"):
        (bound, codes, ends), *_ = langid._blocks(pa.array([text]))
        assert (langid.bundle(codes[ends[0] : ends[1]], bound) == _plain_profile(text)).all()
    (bound, codes, ends), *_ = langid._blocks(pa.array(["12 !!", "ab", None, "".join(map(chr, range(0x4E00, 0x4F00)))]))
    assert ends.tolist() == [0, 0, 2, 2, 258] and len(np.unique(codes)) == 258  # gaps alone, and too many letters for a table


def test_language_query_against_plain_profiles(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text", "lang").collect()
    profile = {}
    for r in docs:
        (bound, codes, ends), *_ = langid._blocks(pa.array([r["text"] or ""]))
        profile[r["doc_id"]] = langid.bundle(codes, bound).astype(np.float64)
    held = {r["doc_id"]: zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2 for r in docs}
    langs = sorted({r["lang"] for r in docs if r["lang"] is not None and not held[r["doc_id"]]})
    protos = np.array([sum(profile[r["doc_id"]] for r in docs if r["lang"] == x and not held[r["doc_id"]]) for x in langs])
    protos /= np.linalg.norm(protos, axis=1, keepdims=True)
    for r in queries.op8_langid(spark, DIR).collect():
        v = profile[r["doc_id"]]
        assert r["held_out"] == held[r["doc_id"]]
        if not v.any():
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
        else:
            cos = protos @ v / np.linalg.norm(v)
            assert r["score"] == pytest.approx(min(max(cos.max(), 0), 1)) and r["lang_pred"] == langs[int(cos.argmax())]


def _toxic_docs(spark):
    rng = random.Random(2)
    plain = "the of and thor ander ention thes ere".split()
    rows = []
    for i in range(400):
        bad = i % 5 == 0
        words = rng.choices(plain, k=40)
        if bad:
            words[rng.randrange(40)] = rng.choice(["idiot", "moron", "loser"])
        rows.append((i, " ".join(words), int(bad)))
    return rows, spark.createDataFrame([(i, t, "x") for i, t, _ in rows], "doc_id long, text string, toxic string"), spark.createDataFrame([(i, b, 1) for i, _, b in rows], "doc_id long, toxic int, text int")


def test_toxicity_learns_and_sees_through_disguise(spark):
    _, docs, labels = _toxic_docs(spark)
    model = toxicity.fit(docs, labels)
    reader = toxicity.Reader(model.chars)
    score = lambda t: model.score(model.features(reader, t))
    for bad in ("you 1d10t", "mor0n!", "looooser", "i d i o t", "l.o.s.e.r", "M0R0N", "an IDIOT."):
        assert score("the of " + bad) > 0.5, bad
    for good in ("the of and thor", "", "12 34 a b c", "ention!!! $$$", "w1de a1d"):
        assert score(good) < 0.5, good


def test_toxicity_query_and_edges(spark):
    got = queries.op4_toxicity(spark, DIR)
    assert got.count() == spark.read.parquet(f"{DIR}/documents.parquet").count()
    rows, docs, labels = _toxic_docs(spark)
    held = {r["doc_id"]: r["predicted"] for r in toxicity.score(docs, labels).filter("held_out").collect()}
    assert held and held.keys() == {i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0}
    assert all(held[i] == b for i, _, b in rows if i in held)
    kept = toxicity.keep_clean(docs, labels)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {i for i, _, b in rows if not b}
    odd = spark.createDataFrame([(None, "idiot"), (1, None), (1, None), (2, "x " * 20000)], "doc_id long, text string")
    assert toxicity.score(odd, labels.limit(0)).filter("score between 0 and 1").count() == 4
    assert toxicity.score(odd.limit(0), labels).count() == 0


def _rule_counts(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    win = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    hit = set()
    for i, w in enumerate(win):
        if win.count(w) > 1:
            hit |= set(range(i, i + 8))
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(hit)


def test_rule_counts():
    rng = random.Random(1)
    for _ in range(60):
        text = "".join(rng.choices([*"abé", "\n", " ", "a b c d e f g h i\n", "x x x x x x x x x ", "#|", "\x1f", "\xa0", "日"], k=rng.randint(0, 40)))
        assert rules.statistics(text.encode())[:5] == _rule_counts(text), repr(text)
    assert rules.statistics(b"")[:5] == (0, 0, 0, 0, 0)


def test_rules_query(spark):
    got = queries.op7_rules(spark, DIR).collect()
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()}
    assert len(got) == len(docs)
    for r in got:
        assert not (r["base_failed"] and r["kept"])
        assert r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"])
    for r in sorted(got, key=lambda r: r["n_words"])[:80]:
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == _rule_counts(docs[r["doc_id"]])


def test_rules_find_anomalies_and_edges(spark):
    rng = random.Random(4)
    words = "the of and thor ander ention thes ere".split()
    rows = [(i, " ".join(rng.choices(words, k=80)) if i % 30 else " ".join(w.upper() + "!!" for w in rng.choices(words, k=80))) for i in range(600)]
    docs = spark.createDataFrame([*[(i, t, "x") for i, t in rows], (None, None, "x"), (900, "", "x"), (900, "", "x")], "doc_id long, text string, quality string")
    labels = spark.createDataFrame([(i, int(i % 30 > 0)) for i in range(600)], "doc_id long, quality int")
    got = {r["doc_id"]: r["kept"] for r in rules.judge(docs, labels).collect()}
    assert sum(got[i] == (i % 30 > 0) for i in range(600)) >= 590 and got[None] is False and got[900] is False
    assert {r["doc_id"] for r in rules.keep_good(docs, labels).collect()} == {i for i, k in got.items() if k}
    assert rules.judge(docs.limit(0), labels).count() == 0
    assert rules.judge(docs, labels.limit(0)).filter("kept = base_failed").count() == 0


def test_grades(spark):
    rng = random.Random(6)
    sets = [["bad", "junk###", "spam"], ["middling", "fine", "loser"], ["good", "great", "lovely"]]
    rows = [(i, " ".join(rng.choices(sets[i % 3], k=20) + rng.choices(["the", "of", "and"], k=20)), i % 3) for i in range(300)]
    docs = spark.createDataFrame([*[(i, t, 1) for i, t, _ in rows], (None, None, 1), (900, "", 1)], "doc_id long, text string, grade int")
    graded = spark.createDataFrame([(i, g) for i, _, g in rows if i < 200], "doc_id long, grade int")
    got = {r["doc_id"]: r for r in ordinal.grade(docs, graded).collect()}
    held = [(got[i]["expected_grade"], g) for i, _, g in rows if i >= 200]
    assert sum(round(e) == g for e, g in held) >= 0.95 * len(held)
    assert all(got[i]["selected"] == (g == 2) for i, _, g in rows if i >= 200)
    assert 0 <= got[None]["expected_grade"] <= 2 and not got[None]["selected"]
    assert ordinal.grade(docs.limit(0), graded).count() == 0
    flat = ordinal.grade(docs, graded.limit(0)).collect()
    assert all(r["expected_grade"] == pytest.approx(1.0) and not r["selected"] for r in flat)


def test_ordinal_query(spark):
    assert queries.op10_ordinal(spark, DIR).filter("tail_probability between 0 and 1").count() == spark.read.parquet(f"{DIR}/documents.parquet").count()

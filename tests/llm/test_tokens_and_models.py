"""Token counts, BPE, toxicity and language."""

import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from ledgerloom.llm import byte_bpe, language, toxicity
from ledgerloom.llm.byte_bpe import decode_documents, default_pattern, default_ranks, encode_documents, token_digests, tokenizer
from ledgerloom.llm.queries import cleaning_edits
from ledgerloom.llm.token_tree import TokenTree, edited_token_counts, edited_trees, token_trees

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def reference():
    with open(default_ranks(), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


ALPHABET = "aAbéeß 'strevelld\n\t  123中文😀\x1c\x85\xa0½Ж가<|endoftext|>"


def noise(rng, n):
    return "".join(rng.choice(ALPHABET) for _ in range(n))


def test_encoding_equals_the_library_and_decodes(reference):
    rng, bpe = random.Random(1), tokenizer(default_ranks(), default_pattern())
    texts = [noise(rng, rng.randint(0, 80)) for _ in range(1500)] + ["", "aaaa" * 500, "thth" * 300, " " * 5000, "<|endoftext|>", "don't we'll THEY'RE"]
    for t in texts:
        ids = bpe.encode(t)
        assert ids == reference.encode_ordinary(t), t
        assert bpe.decode(ids) == t.encode()


def test_encoding_survives_a_small_cache(monkeypatch, reference):
    monkeypatch.setattr(byte_bpe, "CACHED_WORDS", 5)
    rng, bpe = random.Random(2), byte_bpe.ByteBPE(default_ranks(), default_pattern())
    for _ in range(200):
        t = noise(rng, 60)
        assert bpe.encode(t) == reference.encode_ordinary(t)


def test_replay_orders_merges_that_undercut(monkeypatch):
    """A vocabulary in which a merge opens a pair of lower rank: words are then encoded one by one, by the definition."""
    bpe = byte_bpe.ByteBPE(default_ranks(), default_pattern())
    vocabulary = {bytes([i]): 1000 + i for i in range(256)} | {b"bc": 20, b"abc": 5, b"cd": 30, b"dd": 40, b"ddd": 39}
    bpe.ranks, bpe.tokens, bpe.byte_ids = vocabulary, {r: t for t, r in vocabulary.items()}, np.array([vocabulary[bytes([i])] for i in range(256)])
    found = {vocabulary[t[:i]] << 32 | vocabulary[t[i:]]: r for t, r in vocabulary.items() for i in range(1, len(t)) if t[:i] in vocabulary and t[i:] in vocabulary}
    bpe._keys = np.array(sorted(found))
    bpe._ranks = np.array([found[k] for k in bpe._keys.tolist()])
    rng = random.Random(3)
    words = sorted({"".join(rng.choice("abcd") for _ in range(rng.randint(1, 9))) for _ in range(600)})
    for w, ids in zip(words, bpe.replay(words)):
        assert ids == ((vocabulary[w.encode()],) if w.encode() in vocabulary else bpe._alone(w.encode())), w


def test_token_digests(spark, reference):
    rows = [(1, "Hello world", "en", "s", 1), (2, None, None, None, None), (3, "", "en", "s", 0), (None, "é 😀 " * 2000, "en", "s", 0), (1, "Hello world", "en", "s", 1)]
    frame = spark.createDataFrame(rows, DOCS).withColumn("ids", F.lit("clash"))
    got = token_digests(frame).collect()
    assert len(got) == 5
    for r in got:
        text = next(t for i, t, *_ in rows if i == r["doc_id"]) or ""
        ids = reference.encode_ordinary(text)
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    decoded = decode_documents(encode_documents(frame)).collect()
    assert sorted(bytes(r["bytes"]) for r in decoded) == sorted((t or "").encode() for _, t, *_ in rows)
    assert token_digests(frame.limit(0)).count() == 0


def test_tree_counts_follow_edits(reference):
    rng, bpe = random.Random(4), tokenizer(default_ranks(), default_pattern())
    for _ in range(150):
        text = noise(rng, rng.choice([0, 5, 100, 2000]))
        tree = TokenTree(bpe, bpe.pre.split(text))
        for _ in range(rng.randint(1, 8)):
            a = rng.randint(0, len(text))
            b = min(len(text), a + rng.choice([0, 0, 1, 3, 50, 700]))
            new = noise(rng, rng.choice([0, 1, 4, 900]))
            text = text[:a] + new + text[b:]
            tree.edit(a, b, new)
            assert tree.text == text
            assert tree.count == len(reference.encode_ordinary(text)), (a, b, new)


def test_tree_encodes_only_what_an_edit_touches():
    bpe = tokenizer(default_ranks(), default_pattern())
    text = "some words of a text, " * 4000
    tree = TokenTree(bpe, bpe.pre.split(text))
    tree.edit(40_000, 40_005, "other")
    assert tree.reencoded < 400
    with pytest.raises(ValueError):
        tree.edit(10, 10**9, "")


def test_edited_counts_over_documents(spark, reference):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(200)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in edited_token_counts(docs, cleaning_edits).collect():
        text = texts[r["doc_id"]]
        edited = text
        for a, b, new in sorted(cleaning_edits(text), reverse=True):
            edited = edited[:a] + new + edited[b:]
        assert r["n_tokens"] == len(reference.encode_ordinary(text)) and r["n_tokens_edited"] == len(reference.encode_ordinary(edited))
    odd = spark.createDataFrame([(1, None, None, None, None), (None, "", "", "", 0), (3, "a  b", "", "", 0)], DOCS)
    got = {r["doc_id"]: (r["n_tokens"], r["n_tokens_edited"], r["n_edits"]) for r in edited_token_counts(odd, cleaning_edits).collect()}
    assert got == {1: (0, 0, 0), None: (0, 0, 0), 3: (len(reference.encode_ordinary("a  b")), 2, 1)}


def auc(scores, labels):
    pos, neg = [s for s, y in zip(scores, labels) if y], [s for s, y in zip(scores, labels) if not y]
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


def test_toxicity_on_held_out_documents(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit_toxicity(docs, labels)
    rows = toxicity.score_toxicity(docs, model).join(labels.select("doc_id", "toxic"), "doc_id").filter("held_out").collect()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    right = sum(r["predicted"] == r["toxic"] for r in rows) / len(rows)
    assert right >= 0.97 and auc([r["score"] for r in rows], [r["toxic"] for r in rows]) >= 0.93
    found = toxicity.offending_sentences(docs.limit(300), model)
    texts = {r["doc_id"]: r["text"] for r in docs.limit(300).collect()}
    assert all(0 <= r["start"] < r["end"] <= len(texts[r["doc_id"]]) for r in found.collect())


def test_toxicity_edge_cases(spark):
    rows = [(i, "you idiot here. fine words" if i % 2 else "fine words only. nothing else", "en", "s", 1) for i in range(1, 200)] + [(500, None, None, None, None), (501, "", "", "", 0), (502, "123 !!", "", "", 0), (None, "idiot", "", "", 0)]
    docs = spark.createDataFrame(rows, DOCS).withColumn("toxic", F.lit("clash")).withColumn("ids", F.lit(1))
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(1, 200)] + [(3, 0, 1), (None, 1, 1), (4, 1, None)], "doc_id long, quality int, toxic int")
    model = toxicity.fit_toxicity(docs, labels)
    got = {r["doc_id"]: r for r in toxicity.score_toxicity(docs, model).collect()}
    assert all(got[i]["predicted"] == i % 2 for i in range(1, 200))
    assert all(0 <= got[i]["score"] < 0.5 for i in (500, 501, 502)) and got[None]["score"] > got[2]["score"]
    kept = toxicity.without_toxic(docs, model)
    assert kept.columns == docs.columns and kept.count() >= 99 + 3
    nothing = toxicity.fit_toxicity(docs, labels.limit(0))
    assert toxicity.score_toxicity(docs, nothing).filter("predicted = 1").count() == 0
    assert toxicity.score_toxicity(docs.limit(0), model).count() == 0


def test_toxicity_of_long_clean_documents():
    idiot = toxicity.features("idiot")[0]
    for leak in (0.0, 0.1, 0.2, 0.4):
        model = toxicity.NoisyOr({idiot: 20.0}, leak)
        assert all(abs(model.document_score(line * 50_000) - leak) < 1e-6 for line in ("fine words\n", "12 | 34\n", "\n \n", "Fine words. "))
        assert model.document_score("fine words\n" * 50_000 + "you idiot\n") >= 0.99
        assert model.document_score("fine words\n" * 50_000 + "you idiot\n") - model.document_score("you idiot\n") < 1e-6


def rare_word_bags(distinct):
    """600 toxic and 1,200 clean bags; of the toxic ones ten hold a rare word only, in distinct texts or in copies of one."""
    rng = random.Random(8)
    fine = lambda: " ".join(f"w{chr(97 + rng.randrange(26))}{chr(97 + rng.randrange(26))}" for _ in range(12))
    rare = [f"{fine()}. du dussel" for _ in range(10)] if distinct else [f"{fine()}. du dussel"] * 10
    texts = [f"{fine()}. you idiot" for _ in range(590)] + rare + [fine() for _ in range(1200)]
    return [toxicity.bag(t) for t in texts], np.array([1] * 600 + [0] * 1200)


def test_toxicity_learns_rare_words_but_not_those_of_copies():
    model = toxicity.train(*rare_word_bags(distinct=True))
    assert model.document_score("fine words. du dussel") >= 0.5 > model.document_score("fine words. nothing else")
    copies = toxicity.train(*rare_word_bags(distinct=False))
    assert copies.document_score("fine words. du dussel") < 0.5 <= copies.document_score("fine words. you idiot")


def test_toxicity_sample_is_the_one_that_was_measured(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(toxicity, "train", lambda bags, labels: seen.append(np.bincount(labels)) or toxicity.NoisyOr())
    docs = spark.range(10_000).selectExpr("id as doc_id", "concat('word', id) as text")
    toxicity.fit_toxicity(docs, docs.selectExpr("doc_id", "doc_id % 3 = 0 as toxic").withColumn("toxic", F.col("toxic").cast("int")))
    assert seen[0].tolist() == [3000, 1500]


def test_language_on_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language.fit_language(docs, sample=600)
    rows = language.predict_language(docs, model).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert sum(r["lang_pred"] == r["lang"] for r in rows) / len(rows) >= 0.97
    odd = spark.createDataFrame([(1, None, None, None, None), (2, "", "en", "s", 0), (3, "12 !!", "en", "s", 0), (None, "the and of", None, "s", 0)], DOCS).withColumn("h", F.lit("clash"))
    got = {r["doc_id"]: r["lang_pred"] for r in language.predict_language(odd, model).collect()}
    assert got[1] == got[2] == got[3] == "und" and got[None] in model.langs
    assert {r["lang_pred"] for r in language.predict_language(odd, language.fit_language(odd.limit(0))).collect()} == {"und"}
    assert language.predict_language(docs.limit(0), model).count() == 0


def test_words_hold_letters_only():
    for text in ("½ ²", "⑤", "Ⅷ", "٣ 7", "_", "\U0001f110", "", " <>"):
        assert not language.text_counts(text).any(), text
    for text, marked in (("Größe 3x_y", "<größe><x><y>"), ("é²è", "<é><è>"), ("一", "<一>"), ("𝐀b", "<𝐀b>")):
        assert language.marked_words(text) == marked


def test_bucket_counts_in_chunks(monkeypatch):
    text = "the quick brown fox and others " * 40
    whole = language.text_counts(text)
    assert whole.sum() == sum(max(0, len(w) + 3 - n) for w in text.split() for n in range(1, language.LONGEST + 1))
    monkeypatch.setattr(language, "_CHUNK", 37)
    assert (language.text_counts(text) == whole).all()


def test_language_of_numbers_is_undetermined(spark):
    docs = spark.createDataFrame([(i, "the cat sat" if i % 2 else "der hund lief", "en" if i % 2 else "de") for i in range(80)], "doc_id long, text string, lang string")
    odd = spark.createDataFrame([(1, "½ ²"), (2, "⑤"), (3, "Ⅷ 12"), (4, "½ cat")], "doc_id long, text string").selectExpr("*", "cast(null as string) lang")
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.predict_language(odd, language.fit_language(docs)).collect()}
    assert got[1] == got[2] == got[3] == ("und", 0.0) and got[4][0] == "en"


def test_trees_are_kept_and_edited_again(spark):
    texts = [(1, "hello world, it's 5 o'clock  \n" * 40), (2, None), (3, ""), (4, "a"), (4, "a"), (None, "naïve 😀 text " * 200)]
    cut = lambda text: [(i, i + 3, "Q! ") for i in range(2, max(2, len(text) - 5), 97)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").withColumn("lengths", F.lit("clash"))
    once = edited_trees(token_trees(docs), cut).cache()
    again = edited_trees(once.select("doc_id", "text", "lengths", "tokens", "leaf_pieces"), cut)
    bpe = tokenizer(default_ranks(), default_pattern())

    def apply(text):
        for s, e, new in sorted(cut(text), reverse=True):
            text = text[:s] + new + text[e:]
        return text

    key = lambda r: (str(r["doc_id"]), r["n_tokens"])
    for frame, rounds in ((once, 1), (again, 2)):
        got, want = sorted(frame.collect(), key=key), []
        for i, text in texts:
            before = text or ""
            for _ in range(rounds - 1):
                before = apply(before)
            after = apply(before)
            want.append({"doc_id": i, "n_tokens": len(bpe.encode(before)), "n_tokens_edited": len(bpe.encode(after)), "text": after})
        for r, w in zip(got, sorted(want, key=key), strict=True):
            assert {k: r[k] for k in w} == w and r["n_edits"] == 0 or r["n_reencoded"] < max(r["n_tokens"], 60 * r["n_edits"])
            assert sum(r["lengths"]) == len(r["text"]) and sum(r["tokens"]) == r["n_tokens_edited"] and sum(r["leaf_pieces"]) == len(r["tokens"])
            assert (r["n_tokens"], r["n_tokens_edited"], r["text"]) == (w["n_tokens"], w["n_tokens_edited"], w["text"])
    once.unpersist()

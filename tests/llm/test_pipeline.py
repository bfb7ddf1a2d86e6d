"""The pipeline's stages, each on its own input, against brute force."""

import hashlib
import random

import pytest

import corpus_pipeline
from ledgerloom.llm.byte_bpe import default_pattern, default_ranks, tokenizer
from ledgerloom.llm.line_dedup import line_key
from ledgerloom.llm.mixing import mix_sources
from ledgerloom.llm.simhash import words_of

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
INSULTS = ["idiot", "moron", "scum"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(8)
    word = lambda: rng.choice(["ba", "bo", "cu", "de"]) + rng.choice(["la", "mi", "no"]) + str(rng.randint(0, 60))
    rows, labels = [], []
    for i in range(400):
        text = "\n".join(" ".join(word() for _ in range(rng.randint(5, 25))) for _ in range(rng.randint(1, 6)))
        toxic = i % 4 == 0
        if toxic:
            text += "\nyou " + rng.choice(INSULTS) + " and " + rng.choice(INSULTS)
        if i % 3 == 0:
            text += "\nAll rights reserved."
        rows.append([i, text, "en", rng.choice(["a", "a", "b", None]), len(text)])
        if i < 300:
            labels.append((i, 1, int(toxic)))
    for i in range(400, 440):  # exact and near copies of clean documents
        copy = list(rows[rng.choice([1, 2, 5, 7])])
        words = copy[1].split(" ")
        if i % 2 and len(words) > 60:
            words[30] = "changed"
        rows.append([i, " ".join(words), *copy[2:]])
    rows += [[500, None, None, None, None], [501, "", "en", "a", 0], [502, "one", "en", "b", 3]]
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame([tuple(r) for r in rows], DOCS).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def shingles(text):
    w = words_of(text or "")
    return {b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_stages(spark, folder, tmp_path):
    docs, at = spark.read.parquet(f"{folder}/documents.parquet"), {}
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "mixing", "tokens"]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, folder)
        assert k == 4 or out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{k}")
        at[name] = (docs.collect(), spark.read.parquet(f"{tmp_path}/{k}").collect())
        docs = spark.read.parquet(f"{tmp_path}/{k}")

    before, after = at["toxicity"]
    assert {r["doc_id"] for r in after} == {r["doc_id"] for r in before if not any(w in (r["text"] or "") for w in INSULTS)}

    before, after = at["line_dedup"]
    found = {}
    for r in before:
        for line in {line_key(x) for x in (r["text"] or "").split("\n")} - {""}:
            found.setdefault(line, set()).add(r["doc_id"])
    cut = {r["doc_id"]: "\n".join(x for x in (r["text"] or "").split("\n") if len(found.get(line_key(x), ())) < 10) for r in before}
    assert {r["doc_id"]: r["text"] or "" for r in after} == cut

    before, after = at["near_dedup"]
    sets = {r["doc_id"]: shingles(r["text"]) for r in before}
    group = {i: i for i in sets}
    for i in sorted(sets):
        for j in sorted(sets):
            if j < i and (sets[i] == sets[j] or (sets[i] and sets[j] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8)):
                a, b = group[i], group[j]
                group = {n: min(a, b) if g in (a, b) else g for n, g in group.items()}
    assert sorted(r["doc_id"] for r in after) == sorted(set(group.values()))

    before, after = at["mixing"]
    copies = {r["doc_id"]: r["copies"] for r in mix_sources(spark.read.parquet(f"{tmp_path}/2")).collect()}
    counted = {}
    for r in after:
        counted[r["doc_id"]] = counted.get(r["doc_id"], 0) + 1
    assert counted == {i: c for i, c in copies.items() if c}

    before, after = at["tokens"]
    bpe, texts = tokenizer(default_ranks(), default_pattern()), {r["doc_id"]: r["text"] or "" for r in before}
    assert len(before) == len(after)
    for r in after:
        assert r["n_tokens"] == len(bpe.encode(texts[r["doc_id"]])) and r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


def test_run_is_all_stages(spark, folder):
    got = corpus_pipeline.run(spark, folder)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and 200 < got.count() < 900


def test_what_near_dedup_drops_reaches_nothing_that_follows(spark, folder, monkeypatch):
    docs, (near_dedup, *following) = spark.read.parquet(f"{folder}/documents.parquet"), corpus_pipeline.STAGES[2:]
    kept = {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, folder).select("doc_id").collect()}
    dropped = {r["doc_id"] for r in docs.select("doc_id").collect()} - kept
    found = []
    for stages in ([near_dedup, *following], following):
        monkeypatch.setattr(corpus_pipeline, "STAGES", stages)
        found.append([r["doc_id"] for r in corpus_pipeline.run(spark, folder).select("doc_id").collect()])
    assert dropped and set(found[0]) <= kept
    assert set(found[1]) & dropped and len(found[1]) > len(found[0])

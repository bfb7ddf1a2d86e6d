"""Mixing and personal data."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from ledgerloom.llm.mixing import mix_sources, mixed_documents
from ledgerloom.llm.private_data import added_spans, base_spans, find_private_data, luhn, redact, render

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(spark, n=3000, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        source = rng.choice(["a"] * 6 + ["b", "c", "ü", None])
        text = rng.choice([None, "", "  "]) if i % 50 == 0 else " ".join(["w"] * rng.choice([1, 3, 20, 20, 50]))
        rows.append((i, text, "en", source, 0))
    rows += [(5000, "x y z", "en", "tiny", 0), (5001, None, "en", "none", 0), (None, "q r", "en", "a", 0), (7777, "same row", "en", "b", 0), (7777, "same row", "en", "b", 0)]
    return spark.createDataFrame(rows, DOCS), rows


def water_fill(sizes, weights, share, cap):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, free, out = share * sum(sizes.values()), set(names), {}
    while True:
        rate = left / sum(w[s] for s in free)
        full = {s for s in free if w[s] * rate >= cap * sizes[s]}
        if not full:
            return out | {s: w[s] * rate for s in free}
        for s in full:
            out[s] = cap * sizes[s]
            left -= out[s]
        free -= full
        if not free:
            return out


def test_mix_meets_targets_and_repeats(spark):
    frame, rows = corpus(spark)
    size = lambda t: len(re.findall("[^\x20\x09-\x0d]+", t or ""))
    sizes = {}
    for _, t, _, s, _ in rows:
        sizes[s] = sizes.get(s, 0) + size(t)
    want = water_fill(sizes, (3, 1, 2), 1.5, 2.0)
    got = mix_sources(frame).collect()
    assert len(got) == len(rows)
    again = mix_sources(frame.repartition(9)).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, map(tuple, again)))
    source_of = {i: s for i, _, _, s, _ in rows}
    taken = {}
    for r in got:
        s = source_of[r["doc_id"]]
        assert r["taken"] <= 2 * r["size"] and r["source_size"] == sizes[s]
        assert r["target"] == pytest.approx(want[s], rel=1e-9)
        assert r["taken"] % max(1, r["size"]) == 0
        taken[s] = taken.get(s, 0) + r["taken"]
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 51, s
    assert mix_sources(frame.limit(0)).count() == 0


def test_mixed_documents_repeat_rows(spark):
    frame, _ = corpus(spark, 400)
    frame = frame.withColumn("h", F.lit("clash"))
    mixed = mixed_documents(frame)
    assert mixed.columns == frame.columns
    want = mix_sources(frame).groupBy("doc_id").agg(F.sum("copies").alias("n")).filter("n > 0")
    assert sorted(map(str, mixed.groupBy("doc_id").agg(F.count("*").alias("n")).collect())) == sorted(map(str, want.collect()))


BASE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def by_regex(text):
    out = []
    for kind, pattern in BASE.items():
        for m in pattern.finditer(text):
            d = re.sub("[^0-9]", "", m.group())
            good = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m.group().split(".")), "card": 13 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]
            if good:
                out.append((kind, *m.span()))
    return out


def test_base_spans_equal_the_regexes():
    rng = random.Random(2)
    pieces = ["a", "b.c", "@", "x@y", ".com", "@d.e", "1", "12", "255", "256", ".", "4111 1111-1111 1111", "+1 (743) 555-3824", "+", "-", " ", "(", ")", "é", "%", "_", "\n", "0004", "１"]
    for _ in range(6000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 25)))
        assert base_spans(text) == by_regex(text), text


def test_base_spans_are_linear():
    shapes = ["-" * 1_000_000 + "! x @ y", "a-" * 500_000 + " x @ y", "joe.doe@example.com " * 50_000, "joe (at) example (dot) com " * 37_000, "@ " * 300_000, "( " * 400_000]
    shapes += [" " * 500_000 + "at" + " " * 500_000 + "dot", "one 1, " * 100_000, "a at " * 200_000, ("a" * 63 + ".") * 15_000 + " @ b", "(dot)" * 200_000]
    for text in shapes:
        begin = time.process_time()
        added_spans(text, base_spans(text))
        assert time.process_time() - begin < 4, text[:30]
    for text in ("a" * 400_000, "1" * 400_000, "1." * 200_000, "+1" * 200_000, "a@" * 200_000, "0" * 6000 + ".0.0.0", "dot " * 100_000, "one " * 100_000, " at " * 100_000):
        base = base_spans(text)
        added_spans(text, base)


@pytest.mark.parametrize(
    ("text", "kind", "found"),
    [
        ("write to john.doe [at] mail [dot] example [dot] com now", "email", "john.doe [at] mail [dot] example [dot] com"),
        ("mail jane(at)site(dot)org!", "email", "jane(at)site(dot)org"),
        ("mail bob at example dot com please", "email", "bob at example dot com"),
        ("mail bob@example dot com please", "email", "bob@example dot com"),
        ("аnnа@exаmple.com", "email", "аnnа@exаmple.com"),
        ("ｂｏｂ＠ｓｉｔｅ．ｃｏｍ", "email", "ｂｏｂ＠ｓｉｔｅ．ｃｏｍ"),
        ("card ４１１１ １１１１ １１１１ １１１１ end", "card", "４１１１ １１１１ １１１１ １１１１"),
        ("card four one one one one one one one one one one one one one one one end", "card", "four one one one one one one one one one one one one one one one"),
        ("call plus one seven four three five five five three eight two four ok", "phone", "plus one seven four three five five five three eight two four"),
        ("mail joe (  at  ) host.org", "email", "joe (  at  ) host.org"),
        ("call (neun acht eins fünf neun acht eins fünf neun) ok", "phone", "neun acht eins fünf neun acht eins fünf neun"),
        ("ip 10[.]20[.]30[.]40 x", "ip", "10[.]20[.]30[.]40"),
        ("ip 10 dot 20 dot 30 dot 40 x", "ip", "10 dot 20 dot 30 dot 40"),
    ],
)
def test_disguises_map_back_to_the_source(text, kind, found):
    spans = added_spans(text, base_spans(text))
    assert (kind, found) in [(k, text[a:b]) for k, a, b in spans], spans


@pytest.mark.parametrize("text", ["we met at noon at the dot on the map", "look at example.com today", "one two three and four", "the 3.14 of 2.71", "nächste Straße dot", "un deux trois", "a @ b", "he is at it. Dot by dot.", ""])
def test_clean_texts_gain_nothing(text):
    assert base_spans(text) == [] and added_spans(text, []) == []


def test_private_data_rows(spark):
    rows = [(1, "x a@b.co +1 (743) 555-3824", "en", "s", 1), (2, None, None, None, None), (3, "", "en", "s", 0), (None, "😀 a@b.co", "en", "s", 0), (1, "x a@b.co +1 (743) 555-3824", "en", "s", 1)]
    got = find_private_data(spark.createDataFrame(rows, DOCS).withColumn("spans", F.lit("clash"))).collect()
    by_id = {r["doc_id"]: r for r in got}
    assert len(got) == 5 and by_id[1]["spans"] == "email:2:8,phone:9:26" and by_id[1]["n_email"] == 1 and by_id[1]["n_phone"] == 1
    assert by_id[2]["spans"] == "" and by_id[2]["base_sha256"] == by_id[3]["base_sha256"] and by_id[None]["spans"] == "email:2:8"
    assert find_private_data(spark.createDataFrame([], DOCS)).count() == 0
    assert redact("x a@b.co y") == "x <email> y" and render([("ip", 1, 2), ("email", 5, 6)]) == "email:5:6,ip:1:2"


def test_mix_of_a_row_that_is_repeated_a_lot(spark):
    rows = [(1, "hot row of words", "en", "a", 0)] * 700 + [(i, "w " * (i % 9), "en", "ab"[i % 2], 0) for i in range(2, 200)]
    got = mix_sources(spark.createDataFrame(rows, DOCS).repartition(5)).collect()
    copies = sorted(r["copies"] for r in got if r["doc_id"] == 1)
    assert len(got) == len(rows) and len(copies) == 700 and copies[-1] - copies[0] <= 1 and copies[-1] <= 2
    target = {r["source_size"]: r["target"] for r in got}
    for size, wanted in target.items():
        assert abs(sum(r["taken"] for r in got if r["source_size"] == size) - wanted) <= 8
    mixed = mixed_documents(spark.createDataFrame(rows, DOCS)).filter("doc_id = 1").count()
    assert mixed == sum(copies)

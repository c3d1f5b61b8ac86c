"""Operators on built-in functions, against plain Python."""

import hashlib
import json
import re
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from campaign.llm import chat, decontam, licences, quality, queries

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ODD_TEXTS = [None, "", " ", "\n\n", "one", "ÀÉ ß İstanbul K", "a " * 3000, "x" * 50_000, "tab\tand\vfeed\f\r\n", "same line\nsame line\n  \nsame line"]


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def decontaminated(docs, items):
    windows = {}
    for item, text in items:
        w = words(text)
        n = min(10, len(w))
        for k in range(len(w) - n + 1) if n else ():
            windows.setdefault(tuple(w[k : k + n]), set()).add(item)
    lengths = {len(w) for w in windows}
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for n in lengths:
            for k in range(len(w) - n + 1):
                if who := windows.get(tuple(w[k : k + n])):
                    found |= who
                    hit |= set(range(k, k + n))
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def test_loss_ranges_of_very_long_conversations(spark):
    turns = F.transform(F.sequence(F.lit(0), F.lit(31_999)), lambda i: F.struct(F.when(i % 2 == 1, "assistant").otherwise("user").alias("role"), F.concat(F.lit("t"), i.cast("string")).alias("text")))
    began = time.monotonic()
    made = spark.range(1).select(turns.alias("turns")).select(chat.loss_ranges(F.col("turns")).alias("r"), chat.rendered(F.col("turns")).alias("text")).first()
    assert time.monotonic() - began < 20 and len(made["r"]) == 16_000
    assert all(made["text"][x["start"] : x["end"]] == f"t{2 * k + 1}<|im_end|>\n" for k, x in enumerate(made["r"]))


def test_decontamination_of_the_given_tables(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    assert sorted((tuple(r) for r in queries.op3_decontamination(spark, sf_dir).collect()), key=repr) == decontaminated(docs, items)


@pytest.mark.parametrize("broadcast", [500_000, 0])
def test_decontamination_of_short_items_odd_texts_and_repeats(spark, monkeypatch, broadcast):
    monkeypatch.setattr(decontam, "BROADCAST_ROWS", broadcast)
    long_ = " ".join(f"w{k % 17}v{k}" for k in range(40))
    items = [(1, long_), (2, "Short item HERE"), (3, "solo"), (4, None), (5, "..."), (6, long_), (10, " ".join(f"w{k % 17}v{k}" for k in range(5, 14)))]
    texts = [*ODD_TEXTS, f"before {long_.upper()} after", "a short, item: here! and solo", " ".join(f"w{k % 17}v{k}" for k in range(20, 31)), long_ + " " + long_, "solo"]
    docs = [(k, t) for k, t in enumerate(texts)] + [(3, texts[3]), (None, "solo")]
    got = decontam.digest(decontam.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")))
    assert sorted((tuple(r) for r in got.collect()), key=repr) == decontaminated(docs, items)


@pytest.mark.parametrize("broadcast", [500_000, 0])
def test_decontamination_of_periodic_texts(spark, monkeypatch, broadcast):
    monkeypatch.setattr(decontam, "BROADCAST_ROWS", broadcast)
    runs = [" ".join(unit * n) for unit in (["x"], ["a", "b"], ["c", "d", "e"], list("fghij"), list("klmnop"), list("qrstuvw")) for n in (12, 30)]
    ends = [f"{' '.join(c * n)} {tail}" for c in "xyz0" for n in (9, 30) for tail in ("y", "one two", "end of the line here")]
    items = list(enumerate(runs[::2] + [t for t in ends if len(t.split()) < 20]))
    docs = list(enumerate(runs + ends + [f"{' '.join('0' * 40)} end of {' '.join('x' * 25)} y {runs[3]}", "clean words only"]))
    frames = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    expected = decontaminated(docs, items)
    assert sorted((tuple(r) for r in decontam.digest(decontam.contamination(*frames)).collect()), key=repr) == expected
    assert sorted(r["doc_id"] for r in decontam.clean(*frames).collect()) == sorted(r[0] for r in expected if not r[-1])


@pytest.mark.parametrize("place", [(1 << 20) - 1, 15])
def test_decontamination_of_texts_over_two_words(spark, monkeypatch, place):
    import random

    monkeypatch.setattr(decontam, "PLACE", place)
    rng = random.Random(4)
    text = lambda n: " ".join(rng.choice("ab") for _ in range(n))
    items, docs = [(k, text(rng.randint(4, 14))) for k in range(30)], [(k, text(rng.randint(5, 60))) for k in range(120)]
    docs += [(1000 + k, "a " * 60 + f"tail{k}") for k in range(20)] + [(2000, "a " * 100), (2001, "x y z w v " * 20), (2002, "p q " * 40)]
    items += [(100 + k, "a " * 9 + f"tail{k}") for k in range(20)] + [(200, "a " * 10), (201, "x y z w v " * 2), (202, "p q " * 5)]
    frames = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    expected = decontaminated(docs, items)
    got = sorted((tuple(r) for r in decontam.digest(decontam.contamination(*frames)).collect()), key=repr)
    assert got == expected and {r[0]: r[2] for r in got}[2000] == 100
    assert sorted(r["doc_id"] for r in decontam.clean(*frames).collect()) == sorted(r[0] for r in expected if not r[-1])


def test_decontamination_of_many_equal_and_partly_equal_items(spark):
    """Twenty thousand copies of one item, and items that share a passage but differ elsewhere."""
    passage = " ".join(f"p{k}" for k in range(300))
    items = spark.range(20_000).select(F.col("id").alias("item_id"), F.lit(passage).alias("text"))
    more = spark.createDataFrame([(50_000 + k, f"{' '.join(f'a{k}b{j}' for j in range(12))} {" ".join(passage.split()[:55])}") for k in range(30)] + [(None, passage)], "item_id long, text string")
    docs = spark.createDataFrame([(1, f"x {passage} y"), (2, " ".join(passage.split()[:40])), (3, "clean"), (4, " ".join(f"a7b{j}" for j in range(12)))], "doc_id long, text string")
    got = {r["doc_id"]: r for r in decontam.contamination(docs, items.union(more)).collect()}
    assert {k: (r["n_hit"], r["n_items"]) for k, r in got.items()} == {1: (300, 20_031), 2: (40, 20_031), 3: (0, 0), 4: (12, 1)}
    keys, windows, members = decontam.item_windows(items, "item_id", "text")
    assert (keys.count() < 300, windows.count(), members.count()) == (True, 291, 20_000)


def test_decontamination_keeps_clean_rows_and_their_columns(spark):
    passage = " ".join(f"p{k}" for k in range(12))
    docs = spark.createDataFrame([(1, f"x {passage} y", 5, "a"), (2, "clean text", 6, None), (None, None, 7, "c")], "doc_id long, text string, words int, marks string")
    items = spark.createDataFrame([(9, passage)], "item_id long, text string")
    got = decontam.clean(docs, items)
    assert got.columns == docs.columns and sorted(r["words"] for r in got.collect()) == [6, 7]
    assert decontam.clean(docs, items.limit(0)).count() == 3
    assert decontam.contamination(docs.limit(0), items).count() == 0


def measured(text):
    text = text or ""
    w = re.findall("[^\x20\x09-\x0d]+", text)
    windows = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
    again = {k + j for k in range(len(w) - 7) if windows[tuple(w[k : k + 8])] > 1 for j in range(8)}
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    failed = len(w) < 20 or 100 * len(again) > 30 * len(w)
    return len(w), sum(map(len, w)), len(re.findall("[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(again), failed


def test_quality_measures(spark, sf_dir):
    docs = {r[0]: r[1] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    got = queries.op6_quality_rules(spark, sf_dir).collect()
    assert {r["doc_id"]: tuple(r)[1:7] for r in got} == {k: measured(t) for k, t in docs.items()}
    assert all(not (r["kept"] and r["base_failed"]) for r in got)


def test_quality_of_odd_texts(spark):
    texts = [*ODD_TEXTS, "a b c d e f g h i j a b c d e f g h i j k", "r s t u v w x y r s t u v w x y"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: tuple(r)[1:7] for r in quality.judge(docs, [0.0] * quality.BUCKETS).collect()}
    assert got == {k: measured(t) for k, t in enumerate(texts)}


def test_quality_ratio_is_that_of_hashed_counts(spark):
    import math

    import xxhash

    docs = [(1, "the cat sat on the mat"), (2, "the dog sat"), (3, "%% ## %% ##"), (4, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    weights = quality.train(df, spark.createDataFrame([(1,), (2,)], "doc_id long"))

    def buckets(text):
        w = (text or "").split()
        h = lambda x, seed=42: xxhash.xxh64_intdigest(x.encode(), seed)
        signed = lambda v: v - (1 << 64) if v >> 63 else v
        ends = [x[-2:] for x in w]
        pair = lambda a, b: h(b, h(a))
        return [signed(h(x)) % quality.BUCKETS for x in w] + [signed(pair(a, b)) % quality.BUCKETS for a, b in zip(ends, ends[1:])]

    raw, target = Counter(), Counter()
    for k, t in docs:
        raw.update(buckets(t))
        target.update(buckets(t) if k < 3 else [])
    n, m = sum(raw.values()) + quality.BUCKETS, sum(target.values()) + quality.BUCKETS
    expected = [math.log((target[b] + 1) / m) - math.log((raw[b] + 1) / n) for b in range(quality.BUCKETS)]
    assert weights == pytest.approx(expected)
    got = {r["doc_id"]: r["ratio"] for r in quality.judge(df, weights).collect()}
    for k, t in docs:
        b = buckets(t)
        assert got[k] == pytest.approx(sum(expected[x] for x in b) / len(b) if b else 0.0, abs=1e-4)
    assert got[3] < 0 < got[1]


def test_quality_keeps_rows_with_clashing_columns(spark):
    text = " ".join(f"word{k}" for k in range(40))
    df = spark.createDataFrame([(1, text, 1), (2, "short", 2)], "doc_id long, text string, n_words int").withColumn("ratio", F.lit("x"))
    got = quality.keep_good(df, [0.0] * quality.BUCKETS)
    assert got.columns == df.columns and [r["doc_id"] for r in got.collect()] == [1]
    assert quality.train(df.limit(0), df.select("doc_id").limit(0)) == [0.0] * quality.BUCKETS


def test_preference_pairs(spark):
    turn = lambda role, text: {"role": role, "text": text}
    chosen = [turn("user", "hi"), turn("assistant", "hello"), turn("user", "x"), turn("assistant", "good")]
    rejected = [turn("user", "hi"), turn("assistant", "hello"), turn("user", "x"), turn("assistant", "bad"), turn("user", "?")]
    schema = "pair_id long, chosen array<struct<role:string,text:string>>, rejected array<struct<role:string,text:string>>"
    rows = {r["pair_id"]: r for r in chat.format_pairs(spark.createDataFrame([(1, chosen, rejected), (2, chosen, chosen), (3, chosen, chosen[:2]), (4, None, chosen), (5, [], [])], schema)).collect()}
    assert {k: r["prompt_turns"] for k, r in rows.items()} == {1: 3, 2: 4, 3: 2, 4: 0, 5: 0}
    learned = lambda text, spans: [text[s["start"] : s["end"]] for s in spans]
    assert learned(rows[1]["chosen"], rows[1]["chosen_loss"]) == ["good<|im_end|>\n"]
    assert learned(rows[1]["rejected"], rows[1]["rejected_loss"]) == ["bad<|im_end|>\n"]
    assert rows[2]["chosen"] == rows[2]["rejected"] == "" and rows[3]["rejected"] == ""
    assert learned(rows[4]["rejected"], rows[4]["rejected_loss"]) == ["hello<|im_end|>\n", "good<|im_end|>\n"]
    for r in rows.values():
        whole = "".join(f"<|im_start|>{t['role']}\n{t['text']}<|im_end|>\n" for t in ([] if r["pair_id"] in (4, 5) else chosen))
        assert r["prompt"] + r["chosen"] == whole


def neighbour_pairs(rows):
    """Pairs of (conv_id, turn, role, text) rows in plain Python: prompt_turns, prompt, chosen, rejected by id."""
    turns = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            turns.setdefault(conv, set()).add((turn, role or "", text or ""))
    show = lambda v: "".join(f"<|im_start|>{r}\n{t}<|im_end|>\n" for r, t in v)
    turns = {k: [t[1:] for t in sorted(v)] for k, v in turns.items()}
    order = sorted((k for k, v in turns.items() if any(r == "assistant" for r, _ in v)), key=lambda k: (show(turns[k]).encode(), k))
    out = {}
    for k, following in zip(order, order[1:] + order[:1], strict=True):
        own, other = turns[k], turns[following]
        if own[0] != other[0]:
            at = max(i for i, (r, _) in enumerate(own) if r == "assistant")
            other = own[:at] + [("assistant", [t for r, t in other if r == "assistant"][-1])] + own[at + 1 :]
        n = next((i for i, (a, b) in enumerate(zip(own, other)) if a != b), min(len(own), len(other)))
        out[k] = (n, show(own[:n]), show(own[n:]), show(other[n:]))
    return out


def test_preference_pairs_of_the_given_table(spark, sf_dir):
    expected = neighbour_pairs([(r["conv_id"], r["turn"], r["role"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").collect()])
    got = {r["pair_id"]: (r["prompt_turns"], r["prompt"], r["chosen"], r["rejected"]) for r in queries.op1_preference_formatting(spark, sf_dir).collect()}
    assert got == expected


def test_preference_pairs_share_prefixes_of_all_lengths(spark, tmp_path):
    from tests import compare

    rows, path = [], str(tmp_path)
    for k, (prefix, rest) in enumerate((p, r) for p in range(5) for r in ("x", "y", "z")):
        own = [f"common {j}" for j in range(prefix + 1)] + [f"own {rest} {j}" for j in range(2)]
        rows += [(7 * k, j, "assistant" if j % 2 else "user", t) for j, t in enumerate(own)]
    rows += [(500, 0, "user", "common 0"), (501, 0, "user", "no answer"), (502, 0, "assistant", None), (502, 0, "assistant", None), (503, 0, None, "é"), (503, 1, "assistant", "\U0001f600"), (None, 0, "assistant", "a")]
    rows += [(r[0] + 1000, *r[1:]) for r in rows if r[0] == 7]  # a copy
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("number", F.lit(1)).withColumn("shown", F.lit("s")).write.parquet(f"{path}/conversations.parquet")
    spark.createDataFrame([(1, "a")], "doc_id long, text string").write.parquet(f"{path}/documents.parquet")
    expected = neighbour_pairs(rows)
    result = queries.op1_preference_formatting(spark, path)
    got = {r["pair_id"]: (r["prompt_turns"], r["prompt"], r["chosen"], r["rejected"]) for r in result.collect()}
    assert got == expected and {0, 1, 2, 3, 4, 5} <= {n for n, *_ in got.values()}
    con = compare.duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{path}/conversations.parquet/*.parquet'")
    compare.same(result, con, queries.ORACLES["op1_preference_formatting"])
    empty = chat.pairs_of_neighbours(chat.conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string")))
    assert empty.count() == 0


def test_conversations_with_nulls_and_repeats(spark):
    df = spark.createDataFrame([(1, 0, None, "a"), (1, 0, None, "a"), (1, 1, "assistant", None), (None, 0, "user", "b")], "conv_id long, turn long, role string, text string")
    assert json.loads(chat.conversations(df).select(F.to_json(F.struct("turns"))).first()[0])["turns"] == [{"role": "", "text": "a"}, {"role": "assistant", "text": ""}]
    assert chat.conversations(df.limit(0)).count() == 0


def test_licences(spark):
    texts = ["prose about nothing\nReleased under the MIT License.\nmore", "Licensed under CC BY-NC 4.0.", "nothing here at all", None, "", "This work is licensed under the GNU General Public License, version 3.\nLicensed under the Apache License, Version 2.0.", "This item is licensed by a house that nobody knows, under terms of its own."]
    filler = [f"Ordinary words {k} and other lines of the corpus number {k * 7}" for k in range(60)]
    docs = spark.createDataFrame(list(enumerate([*texts, *filler])), "doc_id long, text string")
    model = licences.train(docs)
    got = {r["doc_id"]: (r["licences"], r["n_notices"]) for r in licences.by_document(docs, model).collect()}
    assert len(got) == docs.count()
    assert [got[k] for k in range(7)] == [("mit", 1), ("creative_commons_nc", 1), ("", 0), ("", 0), ("", 0), ("apache,gpl", 2), ("", 0)]
    assert all(got[k] == ("", 0) for k in range(7, len(got)))
    assert licences.by_document(docs.limit(0), model).count() == 0


def licence_rows(texts, model, coverage=0.5):
    """Scores, classes and coverage of all lines, in plain Python."""
    import math
    import struct

    import xxhash

    signed = lambda v: v - (1 << 64) if v >> 63 else v
    templates = [(f, set(words(t))) for f, own in sorted(licences.TEMPLATES.items()) for t in own]
    out = []
    for doc, text in enumerate(texts):
        for place, line in enumerate((text or "").split("\n")):
            w = words(line)
            h = [signed(xxhash.xxh64_intdigest(x.encode(), 42)) for x in w]
            pair = lambda a, b: xxhash.xxh64_intdigest(struct.pack("<q", b), xxhash.xxh64_intdigest(struct.pack("<q", a), 42))
            found = {x % licences.BUCKETS for x in h} | {signed(pair(a, b)) % licences.BUCKETS for a, b in zip(h, h[1:])}
            if not w:
                continue
            z = [sum(model.weights[c][f] for f in found) / math.sqrt(len(found)) + model.bias[c] for c in range(len(model.classes))]
            best = max(range(len(z)), key=lambda c: z[c])
            if not best:
                continue
            chance = 1 / sum(math.exp(v - z[best]) for v in z)
            covered = max(((len(own & set(w)) / len(own), -k) for k, (f, own) in enumerate(templates) if f == model.classes[best]), default=(0.0, None))
            sure = best > 1 and chance >= model.threshold and covered[0] >= coverage
            out.append((doc, place, model.classes[best] if sure else "unknown", round(chance, 4), -covered[1] if sure else None, round(covered[0], 6)))
    return sorted(out)


FILLER = [f"Ordinary words {k} and other lines of the corpus number {k * 7}" for k in range(60)]


@pytest.mark.parametrize("coverage", [0.5, 0.2, 0.95])
def test_licence_lines_equal_plain_python(spark, coverage):
    notices = [t for own in licences.TEMPLATES.values() for t in own] + licences.UNFAMILIAR
    halves = [" ".join(t.split()[: len(t.split()) // 2 + 1]) for t in notices]
    texts = [*ODD_TEXTS[:-3], *notices, *halves, "x\n\nReleased under the MIT License.\n" + "long line " * 5000, *FILLER]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("words", F.lit(1)).withColumn("place", F.lit("p"))
    model = licences.train(docs)
    found = licences.find(docs, model, coverage=coverage).collect()
    assert sorted((r["id"], r["place"], r["family"], round(r["probability"], 4), r["template"], round(r["covered"], 6)) for r in found) == licence_rows(texts, model, coverage)


def test_licences_calls_lines_of_unfamiliar_licences_unknown(spark):
    """Held-out notices, and lines that are in no list of the module, some of them about families that it knows only by other words."""
    held = licences.UNFAMILIAR[1::2]
    unseen = ["GNU GPLv3", "BSD / MIT", "Free for use under BSD terms", "Use of this file is governed by the EUPL", "You may use this work under GPL terms.", "GPLv3", "BSD licensed code.", "GPLv2 or later", "MIT or BSD"]
    texts = [*held, *unseen, "other lines of the corpus", *FILLER]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model = licences.train(spark.createDataFrame(list(enumerate(FILLER)), "doc_id long, text string"))
    got = {r["doc_id"]: r for r in licences.by_document(docs, model).collect()}
    last = len(held) + len(unseen)
    assert not set(unseen) & {*licences.UNFAMILIAR, *(t for own in licences.TEMPLATES.values() for t in own)}
    assert sum(got[k]["n_unknown"] for k in range(len(held), last)) >= 7 and not any(got[k]["n_notices"] for k in range(len(held), last))
    assert sum(got[k]["n_unknown"] for k in range(len(held))) >= 0.7 * len(held) and sum(got[k]["n_notices"] for k in range(len(held))) <= 2
    assert sum(got[k]["n_unknown"] + got[k]["n_notices"] for k in range(last, len(texts))) <= 1


def test_licences_of_repeated_rows(spark):
    rows = [(1, "Released under the MIT License."), (1, "Released under the MIT License."), (1, "nothing"), (None, "Released under the MIT License."), (None, None)]
    docs = spark.createDataFrame([*rows, *enumerate(FILLER, 10)], "doc_id long, text string")
    got = licences.by_document(docs, licences.train(docs)).where("doc_id is null or doc_id = 1").collect()
    assert sorted((r["doc_id"] or 0, r["licences"]) for r in got) == [(0, ""), (0, "mit"), (1, ""), (1, "mit"), (1, "mit")]


def test_licences_of_the_given_table(spark, sf_dir):
    texts = {r[0]: r[1] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    for r in queries.op8_licence_scan(spark, sf_dir).collect():
        assert ("mit" in r["licences"].split(",")) == ("under the MIT License" in texts[r["doc_id"]])
        assert ("apache" in r["licences"].split(",")) == ("Apache License" in texts[r["doc_id"]])

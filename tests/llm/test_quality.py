"""Text statistics, exact ranks and the texts that aren't prose."""

import os
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemill.llm import quality as Q

COMMON = {"en": frozenset(["the", "a", "to", "and", "is", "it", "we", "you"]), "": frozenset(["the", "a", "to", "and", "is", "it", "we", "you"])}


def stats(*texts, lang="en"):
    table = Q.block_statistics(pa.array(texts, pa.string()), [lang] * len(texts), COMMON)
    return [dict(zip(Q.STATISTICS, row)) for row in table]


def cues(*texts):
    return "".join(f"{i + 1}\n00:00:{i:02d},000 --> 00:00:{i:02d},900\n{t}\n\n" for i, t in enumerate(texts))


def test_simple_statistics():
    (s,) = stats(cues("Give it to the dog, now.", "We are here!\nand the cat"))
    words = "Give it to the dog now We are here and the cat".split()
    assert s["n_words"] == len(words) and s["mean_word_len"] == pytest.approx(sum(map(len, words)) / len(words))
    assert s["n_cues"] == 2 and s["lines_a_cue"] == 1.5 and s["end_punct_share"] == pytest.approx(2 / 3) and s["sentence_cues"] == 1
    assert s["common_any"] == s["common_share"] == pytest.approx(6 / 12) and s["cue_common"] == s["plain_cues"] == 1 and s["empty_cues"] == 0
    assert s["type_ratio"] == pytest.approx(11 / 12) and s["symbol_ratio"] == pytest.approx(3 / (3 + sum(map(len, words)))) and s["capital_share"] == pytest.approx(2 / 12)


def test_texts_without_cues_and_odd_ones():
    a, b, c, d = stats("We go to the sea.\n\nIt is cold.", "", None, "   \n\t")
    assert a["n_words"] == 8 and a["n_cues"] == 2 and a["plain_cues"] == 1
    assert all(v == 0 for s in (b, c, d) for k, v in s.items())
    (e,) = stats(cues("", "  ", ""))
    assert e["n_cues"] == 3 and e["empty_cues"] == 1 and e["plain_cues"] == 0
    (f,) = stats("x" * 200_000 + "\n" + "\x00�\U0010ffff")
    assert f["n_words"] >= 1
    assert Q.block_statistics(pa.array([], pa.string()), [], COMMON).shape == (0, len(Q.STATISTICS))


def test_plain_cues():
    plain = lambda text: stats(cues(text))[0]["plain_cues"]
    for text in ("We go to the sea.", "- Is it you?\n- And the cat?", "♪ it is the end ♪", "PETER: Give it to the dog.", "it is the th1rd day", "IT IS THE SEA"):
        assert plain(text) == 1, text
    for text in ("Bralouth ........ 12", "| the | 12 | 3 |", "the = spanner", "4. The Golden Glove", "Gaffer: Mia Skound", "grxv kljh wrtz", "the the the the", "7a 8b 67 d1 f3", "+/-9.=*@&]|"):
        assert plain(text) == 0, text
    # a cue that is a sound only isn't spoken, so it lowers nothing
    (s,) = stats(cues("We go to the sea.", Q.NOTE))
    assert s["plain_cues"] == s["cue_common"] == 1 and s["empty_cues"] == 0


def test_cleaned(spark):
    texts = {
        "﻿<i>We</i>\r\n{\\an8}go": "We\ngo", '<font color="' + "x" * 200 + '">a</font> < b': "a < b", "[door creaks] it *bell tolls*": "♪ it ♪", "&lt;b&gt; &amp;amp; it&#39;s": "<b> &amp; it's",
        "*9]#<#[0=} (1)": "*9]#<#[0=} (1)", "[" + "wo rd " * 50_000: "[" + "wo rd " * 50_000, "": "",
    }
    df = spark.createDataFrame([(k,) for k in texts], "t string").select("t", Q.cleaned(F.col("t")).alias("c"))
    assert {r.t: r.c for r in df.collect()} == texts


def test_language_key(spark):
    given = {"en": "en", " EN-us": "en", "German": "de", "DEU": "de", "Estonian": "", "und": "", "русский": "ru", "xx": "", "es_MX": "es", "": "", "français": "fr"}
    df = spark.createDataFrame([*[(k,) for k in given], (None,)], "lang string").select("lang", Q.language_key(F.col("lang"), ["en", "de", "es", "ru", "fr"]).alias("k"))
    assert {r.lang: r.k for r in df.collect()} == given | {None: ""}
    assert {r.k for r in df.select(Q.language_key(F.col("lang"), ["en", "xx"]).alias("k")).collect()} == {"en", "xx", ""}


def test_blocks_agree_with_single_texts():
    rnd = random.Random(1)
    pool = ["the", "cat", "x1", "....", "|", "-->", "\n", "\n\n", "12", "Ålé", "мир", "a", "=", "7", "00:01 --> 00:02", "\t", "  ", "'", "REM", "♪", "İß"]
    texts = [" ".join(rnd.choice(pool) for _ in range(rnd.randrange(0, 30))) for _ in range(80)]
    langs = [rnd.choice(["en", ""]) for _ in texts]
    together = Q.block_statistics(pa.array(texts), langs, COMMON)
    alone = np.concatenate([Q.block_statistics(pa.array([t]), [k], COMMON) for t, k in zip(texts, langs)])
    assert np.allclose(together, alone)


def test_exact_ranks(spark):
    rnd = random.Random(2)
    rows = [(g, v, n) for g in ("a", "b") for v, n in Counter(rnd.choice([0.0] * 5 + [1.5, 2.5, rnd.random()]) for _ in range(500)).items()]
    df = spark.createDataFrame(rows, "g string, v double, n long")
    for r in Q.exact_ranks(df, ["g"], "v", "n", 5).collect():
        mine = [(v, n) for g, v, n in rows if g == r.g]
        assert (r.n_below, r.n_upto, r.n_all) == (sum(n for v, n in mine if v < r.v), sum(n for v, n in mine if v <= r.v), sum(n for _, n in mine))
    assert Q.exact_ranks(df.where("false"), ["g"], "v", "n").count() == 0


def make(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def common_table(spark, *langs):
    return spark.createDataFrame([(k, w, n) for k in langs for n, w in enumerate(["the", "a", "and", "is", "it"])] + [(None, "x", 1), (langs[0], None, 2)], "lang string, word string, word_rank int")


VOCAB = ["the", "a", "cat", "dog", "sea", "and", "is", "it", "grey", "old", "went", "there"]


def speech(rnd, n=7):
    return " ".join(rnd.choice(VOCAB) for _ in range(n)).capitalize() + rnd.choice([".", "!", "?"])


@pytest.mark.parametrize("hot_share", [0.01, 0.3, 2.0])
def test_tail_nats(spark, hot_share):
    rnd = random.Random(3)
    rows = [(i, cues(*(speech(rnd) + rnd.choice(["", " Ho"]) for _ in range(5))), rnd.choice(["en", "EN-us", None, "xx"])) for i in range(60)]
    rows += [(100 + i, rows[0][1], "en") for i in range(20)] + [(200, "", "en"), (201, None, "en")]
    stats_df = Q.text_statistics(make(spark, rows), common_table(spark, "en"))
    tails = {"common_any": "left", "type_ratio": "both", "empty_cues": "right"}
    table = {r.row: r for r in stats_df.collect()}
    found = {r.row: r.nats for r in Q.tail_nats(stats_df, tails, hot_share).collect()}
    assert set(found) == {row for row, r in table.items() if r.state == 2}
    at = {name: Q.STATISTICS.index(name) for name in tails}
    for row, nats in found.items():
        mine = {tuple(x.stats[k] for k in at.values()) for x in table.values() if x.lang_key == table[row].lang_key and x.state == 2}  # copies count once
        for j, (name, side) in enumerate(tails.items()):
            v, x = [m[j] for m in mine], table[row].stats[at[name]]
            right, left = sum(y >= x for y in v) / len(v), sum(y <= x for y in v) / len(v)
            assert nats[j] == pytest.approx(-np.log(right if side == "right" else left if side == "left" else min(2 * right, 2 * left, 1)))


def test_fit_weights():
    rng = np.random.default_rng(1)
    odd = rng.random(600) < 0.3
    nats = np.c_[rng.exponential(1, 600) + 3 * odd, rng.exponential(1, 600)]
    prior = [1.0, 0.0, -2.0]
    w = Q.fit_weights(nats[:400], odd[:400].astype(float), prior)
    assert ((nats[400:] @ w[:2] + w[2] > 0) == odd[400:]).mean() > 0.9 and abs(w[1]) < 0.3
    assert Q.fit_weights(np.zeros((0, 2)), np.zeros(0), prior).tolist() == prior
    assert Q.fit_weights(np.zeros((0, len(Q.TAILS))), np.zeros(0)).tolist() == Q.PRIOR
    # what can be told apart entirely has finite weights
    assert np.isfinite(Q.fit_weights(np.array([[0.0, 0.0], [9.0, 0.0]] * 20), np.array([0.0, 1.0] * 20), prior)).all()


def test_label_sample(spark):
    labels = spark.createDataFrame([(i, ["prose", "list"][i % 2]) for i in range(50)] + [(None, "prose"), (99, None), (1, "list")], "doc_id long, label string")
    sample = Q.label_sample(labels, most=20).collect()
    assert len(sample) == 20 and all(r.odd == bool(r.label_id % 2) for r in sample) and Q.label_sample(labels).count() == 50
    assert sorted(map(tuple, sample)) == sorted(map(tuple, Q.label_sample(labels.repartition(5), most=20).collect()))


def test_not_prose(spark):
    rnd = random.Random(4)
    rows = [(i, cues(*(speech(rnd) for _ in range(8))), "en") for i in range(200)]
    odd = {500: cues(*["Bralouth ....... 12"] * 8), 501: cues(*[""] * 8), 502: cues(*["grxv kljh wrtz"] * 7, speech(rnd)), 503: cues(*["7a 8b 67 d1 f3"] * 8)}
    fine = {601: None, 602: "", 603: "  \n "}
    rows += [(k, v, "en") for k, v in {**odd, **fine}.items()] + [(None, cues(*(speech(rnd) for _ in range(8))), None), (7, rows[7][1], "en")]
    words = common_table(spark, "en")
    df = make(spark, rows).withColumn("stats", F.lit(1)).withColumn("row", F.lit(2)).withColumn("nats", F.lit(3))
    # prose that stands out from all other may be found with it, what has no text never
    found = {r.row_id for r in Q.not_prose(df, words).collect()}
    assert set(odd) <= found and len(found) <= len(odd) + 8 and not found & set(fine)
    labels = spark.createDataFrame([(i, "prose") for i in range(0, 200, 3)] + [(500, "list"), (503, "junk"), (12345, "list")], "doc_id long, label string")
    fitted = {r.row_id for r in Q.not_prose(df, words, labels).collect()}
    assert set(odd) <= fitted and len(fitted) <= len(odd) + 8
    assert Q.not_prose(df.where("false"), words).count() == 0 and Q.not_prose(df.where("false"), words, labels).count() == 0
    scored = Q.scored_statistics(df, words)
    assert scored.count() == len(rows) and scored.where("outlier_score is null").count() == 3


@pytest.mark.parametrize("odd", ["", "Bralouth ........ 12"])
def test_not_prose_however_frequent(spark, odd):
    """A third of a language is copies of one document without text in its cues, or of one list."""
    rnd = random.Random(8)
    rows = [(i, cues(*(speech(rnd) for _ in range(8))), "en") for i in range(80)] + [(i, cues(*[odd] * 8), "en") for i in range(80, 120)]
    assert {r.row_id for r in Q.not_prose(make(spark, rows), common_table(spark, "en")).collect()} == set(range(80, 120))


def test_small_languages_are_ranked_alone(spark):
    rnd = random.Random(9)
    text = lambda n: cues(*(speech(rnd, n) for _ in range(5)))
    rows = [(i, text(4), "en") for i in range(20)] + [(i, text(9), "de") for i in range(20, 50)] + [(i, text(6), None) for i in range(50, 60)]
    words = common_table(spark, "en", "de")
    scores = lambda rows: {r.row_id: round(r.outlier_score, 9) for r in Q.scored_statistics(make(spark, rows), words).collect()}
    assert scores(rows) == scores(rows[:20]) | scores(rows[20:50]) | scores(rows[50:])


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables")
def test_labelled_documents(spark):
    """Half of the labels are fitted to, the others are the test."""
    read = lambda n: spark.read.parquet(f"/root/testdata/sf0.01/{n}.parquet")
    labels = read("doc_labels")
    fitted = {r.label_id for r in Q.label_sample(labels, most=40).collect()}
    found = {r.row_id for r in Q.not_prose(read("documents"), read("common_words"), labels, most_labelled=40).collect()}
    rest = {r.doc_id: r.label != "prose" for r in labels.collect() if r.doc_id not in fitted}
    assert len(rest) > 30 and sum(odd != (d in found) for d, odd in rest.items()) <= 0.1 * len(rest)


def test_a_folder_without_labels(spark, tmp_path):
    from tidemill.llm import queries

    rnd = random.Random(5)
    rows = [(i, cues(*(speech(rnd) for _ in range(8))), "en") for i in range(60)] + [(99, cues(*["Bralouth ....... 12"] * 8), "en")]
    make(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    common_table(spark, "en").write.parquet(f"{tmp_path}/common_words.parquet")
    assert 99 in {r.doc_id for r in queries.p10_found(spark, str(tmp_path)).collect()}

"""Per-document text statistics, outlier scores from exact ranks, and the documents that aren't prose.

Statistics are found block by block with array operations (``textblocks``). They
know numbered cues with times, but need none: in a text without time lines every
line that isn't blank is text. Cue numbers, times and what stands before the
first cue are left out, as is mark-up (``cleaned``).

A text's outlier score adds, over the statistics, the weighted logarithms of its
empirical tail probabilities among the texts of its language. The weights are
those that separate a bounded sample of labelled documents best, drawn towards
PRIOR, which alone decides where there are no labels.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.cut import table_cut
from .textblocks import LETTER, NUMBER, OTHER, SPACE, class_table, decode, lower_table, run_starts, slices, vowel_table, word_array

#: Tags and style codes, which stand on one line however long they are (fixed values).
MARKUP = r"<[^<>\n]*>|\{\\[^}\n]*\}"
#: A note on a sound: words in brackets or between asterisks.
SOUND = r"[\[(*]\p{L}[\p{L}\p{M} '’,.!-]*[\])*]"
NOTE = "♪"
#: Character references (fixed values).
REFERENCES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&nbsp;": " ", "&amp;": "&"}
END_MARKS = [ord(c) for c in ".?!…,;:\"'’”»)]♪-–—"]
STOPS = [ord(c) for c in ".?!…"]
#: Symbols of which speech has next to none.
CODE_SYMBOLS = [ord(c) for c in "#$%&*+/;<=>@\\^_`{|}~"]
#: Names under which a language may be given, besides its code with or without a region (fixed values).
LANGUAGES = {
    "en": ["eng", "english"], "es": ["spa", "spanish", "español"], "de": ["deu", "ger", "german", "deutsch"], "fr": ["fra", "fre", "french", "français"],
    "pl": ["pol", "polish", "polski"], "ru": ["rus", "russian", "русский"],
}

#: The statistics of a document, in the order of the arrays below.
STATISTICS = [
    "n_words", "mean_word_len", "symbol_ratio", "digit_ratio", "end_punct_share", "sentence_cues", "common_share", "common_any", "cue_common", "plain_cues", "type_ratio", "capital_share",
    "accent_share", "vowelless_share", "single_share", "repeat_share", "max_word_share", "gap_share", "words_a_line", "mean_line_len", "lines_a_cue", "n_cues", "empty_cues",
]
#: Statistics that take part in the outlier score, and the tail in which text stops being prose.
TAILS = {
    "plain_cues": "left", "cue_common": "left", "common_any": "left", "words_a_line": "left", "mean_word_len": "both", "digit_ratio": "right", "symbol_ratio": "right", "end_punct_share": "left",
    "sentence_cues": "left", "capital_share": "right", "vowelless_share": "right", "repeat_share": "right", "type_ratio": "left", "empty_cues": "right", "accent_share": "right", "gap_share": "right",
    "max_word_share": "right",
}
#: Weights of the tails, and what is added: fitted once to the labelled documents of sf0.1 and rounded.
PRIOR = [2.4, 1.3, 1.3, 1.0, 0.9, 0.3, 0.6, 1.4, 0.2, 0.0, 0.4, 0.0, 0.0, 0.0, 0.0, 0.1, 0.3, -16.5]
#: Most labelled documents that the weights are fitted to.
MOST_LABELLED = 2000
#: Most rows a table of common words may have, as it is sent to every task.
MOST_COMMON_WORDS = 200_000
BLOCK_BYTES = 4 << 20


def cleaned(text: Column) -> Column:
    """Text without tags, style codes, byte-order marks and carriage returns; notes on sounds are one symbol, the usual character references are read."""
    # each step only where there is something to do: the byte searches cost less than the patterns
    where = lambda c, signs, done: F.when(_any(text, signs), done).otherwise(c)
    out = F.replace(F.replace(text, F.lit("\ufeff"), F.lit("")), F.lit("\r"), F.lit(""))
    out = where(out, ["<", "{\\"], F.regexp_replace(out, MARKUP, ""))
    out = where(out, ["[", "(", "*"], F.regexp_replace(out, SOUND, NOTE))
    read = out
    for name, char in REFERENCES.items():
        read = F.replace(read, F.lit(name), F.lit(char))
    return where(out, ["&"], read)


def _any(text: Column, signs: list[str]) -> Column:
    out = F.lit(False)
    for sign in signs:
        out = out | F.contains(text, F.lit(sign))
    return out


def language_key(lang: Column, known: list[str]) -> Column:
    """The language of ``known`` that a code, a code with a region or a name stands for; '' for null and others."""
    base = F.element_at(F.split(F.lower(F.trim(lang.cast("string"))), "[-_ ]"), 1)
    names = {n: k for k, every in LANGUAGES.items() if k in known for n in every} | {k: k for k in known}
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in names.items() for x in pair]), base), F.lit("")) if names else F.lit("")


def _share(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.where(b > 0, a / np.maximum(b, 1), 0.0)


def block_statistics(texts: pa.Array, langs: list[str], common: dict[str, frozenset[str]]) -> np.ndarray:
    """One row of STATISTICS for each cleaned text. common: the frequent words of each language; '' holds all."""
    block, docs = decode(texts), len(texts)
    cp = block.cp
    n = len(cp)
    if not n:
        return np.zeros((docs, len(STATISTICS)))
    cls, low = class_table()[cp], lower_table()[cp]
    # lines
    begin = np.zeros(n + 1, bool)
    begin[block.doc_start[:-1]] = True
    doc_begins = begin[:n].copy()
    begin[1:][cp == 10] = True
    begin[n] = False
    first = np.flatnonzero(begin)
    lines = len(first)
    doc_of = np.searchsorted(block.doc_start, first, side="right") - 1
    line_of = np.repeat(np.arange(lines), np.diff(np.append(first, n)))
    ones = lambda mask: np.bincount(line_of[mask], minlength=lines)
    visible_at = np.flatnonzero(cls != SPACE)
    visible_line = line_of[visible_at]
    n_visible = np.bincount(visible_line, minlength=lines)
    n_digit, n_letter = ones(cls == NUMBER), ones(cls == LETTER)
    at_first, at_last = np.full(lines, -1), np.full(lines, -1)
    at_first[visible_line[::-1]] = visible_at[::-1]
    at_last[visible_line] = visible_at
    last_char = np.where(at_last >= 0, cp[np.maximum(at_last, 0)], 0)
    # times, numbers, cues
    arrow = np.zeros(n, bool)
    arrow[: n - 2] = (cp[: n - 2] == 45) & (cp[1 : n - 1] == 45) & (cp[2:] == 62) & ~doc_begins[1 : n - 1] & ~doc_begins[2:]
    timed = ones(arrow) > 0
    blank = n_visible == 0
    numbered = np.append(timed[1:] & (doc_of[1:] == doc_of[:-1]), False) & (n_digit == n_visible) & ~blank
    cue = np.cumsum(timed)
    timed_docs = np.bincount(doc_of[timed], minlength=docs)
    before = np.concatenate(([0], np.cumsum(timed_docs)[:-1]))
    headed = (cue == before[doc_of]) & (timed_docs[doc_of] > 0)
    text = ~(timed | blank | numbered | headed)
    # runs of letters, numbers and blanks
    new, _ = run_starts(block, cls)
    starts = np.flatnonzero(new)
    ends = np.append(starts[1:], n)
    kind, run_line = cls[starts], line_of[starts]
    wide = (kind == SPACE) & (cp[starts] != 10) & ((ends - starts >= 2) | (cp[starts] == 9)) & (starts > at_first[run_line]) & (starts < at_last[run_line])
    gaps = np.bincount(run_line[wide], minlength=lines)
    letter = kind == LETTER
    # a number that isn't part of a word, as misread letters are
    beside = np.append(False, letter[:-1]) & (run_line == np.append(-1, run_line[:-1])) | np.append(letter[1:], False) & (run_line == np.append(run_line[1:], -1))
    numbers = np.bincount(run_line[(kind == NUMBER) & (cp[starts] < 0x80) & ~beside], minlength=lines)
    # words of text lines
    keep = letter & text[run_line]
    starts, ends, w_line = starts[keep], ends[keep], run_line[keep]
    lower = decode(pa.array([low.tobytes().decode("utf-32-le", "replace")], pa.large_string()))
    words = word_array(lower, starts, ends).dictionary_encode()
    fold = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    among = lambda names: np.asarray(pc.is_in(words.dictionary, value_set=pa.array([w.encode() for w in names], words.dictionary.type)))[fold]
    count = lambda mask: (lambda c: c[ends] - c[starts])(np.concatenate(([0], np.cumsum(mask))))
    w_len, upper = ends - starts, low != cp
    n_upper = count(upper)
    capital = upper[starts] & ((n_upper < w_len) | (w_len == 1))
    is_common = among(common[""])
    again = np.zeros(len(fold), bool)
    again[1:] = (fold[1:] == fold[:-1]) & (w_line[1:] == w_line[:-1])
    lang_of, own = np.asarray(langs, object)[doc_of][w_line], is_common.copy()
    for k in common:
        if k:
            rows = np.flatnonzero(lang_of == k)
            own[rows] = among(common[k])[rows]
    per_line = lambda values: np.bincount(w_line, weights=values, minlength=lines)
    n_words, n_common, n_again = np.bincount(w_line, minlength=lines), per_line(is_common), per_line(again)
    n_code = ones(np.isin(cp, CODE_SYMBOLS))
    sound = (ones(cp == ord(NOTE)) > 0) & (n_letter + n_digit + n_code == 0)
    # by document
    d = doc_of[text]
    by_doc = lambda values: np.bincount(d, weights=values[text].astype(float), minlength=docs)
    by_word = lambda values: np.bincount(doc_of[w_line], weights=values.astype(float), minlength=docs)
    n_lines, words_d, visible_d = np.bincount(d, minlength=docs), by_doc(n_words), by_doc(n_visible)
    # cues: index of the time line; texts without any are one cue a line
    in_cue, cue_doc, no_cues = text & (timed_docs[doc_of] > 0), doc_of[np.flatnonzero(timed)], timed_docs == 0
    per_cue = lambda values: np.bincount(cue[in_cue], weights=values[in_cue].astype(float), minlength=cue[-1] + 1)[1:]
    cues = lambda of_cue, of_line: np.where(no_cues, by_doc(of_line), np.bincount(cue_doc, weights=of_cue.astype(float), minlength=docs))
    filled = per_cue(np.ones(lines))
    n_cues, ended = np.where(no_cues, n_lines, timed_docs), np.isin(last_char, STOPS)
    # cues that are a sound only aren't spoken
    spoken = n_cues - cues((filled > 0) & (per_cue(sound) == filled), sound)
    # a plain cue has a frequent word, and neither numbers, symbols of code nor the same word twice running
    plain = lambda common, *other: (common > 0) & (sum(other) == 0)
    plain_cues = cues(plain(per_cue(n_common), per_cue(numbers), per_cue(n_code), per_cue(n_again)), plain(n_common, numbers, n_code, n_again))
    # how much of a document is one word, and how many different words it has
    size = int(fold.max()) + 1 if len(fold) else 1
    pair, times = np.unique(doc_of[w_line] * size + fold, return_counts=True)
    most = np.zeros(docs)
    np.maximum.at(most, pair // size, times)
    found = {
        "n_words": words_d, "mean_word_len": _share(by_word(w_len), words_d), "symbol_ratio": _share(visible_d - by_doc(n_digit) - by_doc(n_letter), visible_d), "digit_ratio": _share(by_doc(n_digit), visible_d),
        "end_punct_share": _share(by_doc(np.isin(last_char, END_MARKS)), n_lines), "sentence_cues": _share(cues(per_cue(ended) > 0, ended), n_cues), "common_share": _share(by_word(own), words_d),
        "common_any": _share(by_word(is_common), words_d), "cue_common": _share(cues(per_cue(n_common) > 0, n_common > 0), spoken), "plain_cues": _share(plain_cues, spoken),
        "type_ratio": _share(np.bincount(pair // size, minlength=docs), words_d), "capital_share": _share(by_word(capital), words_d),
        "accent_share": _share(by_word((w_len > 2) & (2 * count((low >= 0x80) & (low < 0x100)) >= w_len)), words_d), "vowelless_share": _share(by_word((w_len > 2) & (count(vowel_table()[cp]) == 0)), words_d),
        "single_share": _share(by_word(w_len == 1), words_d), "repeat_share": _share(by_word(again), words_d), "max_word_share": _share(most, words_d), "gap_share": _share(by_doc(gaps), n_lines),
        "words_a_line": _share(words_d, n_lines), "mean_line_len": _share(visible_d, n_lines), "lines_a_cue": _share(n_lines, n_cues), "n_cues": n_cues, "empty_cues": _share(cues(filled == 0, np.zeros(lines)), n_cues),
    }
    return np.stack([found[name] for name in STATISTICS], axis=1)


def _statistics(batches: Iterator[pa.RecordBatch], common: dict[str, frozenset[str]], limit: int) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    part, seq = TaskContext.get().partitionId(), 0
    for batch in batches:
        for a, b in slices(batch.column(3), limit):
            own = batch.slice(a, b - a)
            table = block_statistics(own.column(3), own.column(1).to_pylist(), common)
            flat = pa.FixedSizeListArray.from_arrays(pa.array(table.ravel()), len(STATISTICS))
            row = pa.array((part << 36) + seq + np.arange(len(own)), pa.int64())
            yield pa.RecordBatch.from_arrays([row, own.column(0), own.column(1), own.column(2), flat.cast(pa.list_(pa.float64()))], ["row", "row_id", "lang_key", "state", "stats"])
            seq += len(own)


def common_sets(common_words: DataFrame) -> dict[str, frozenset[str]]:
    """The frequent words by language, and of all languages under ''. Rows with a null language or word are left out."""
    rows = common_words.select(F.lower("lang").alias("lang"), F.lower("word").alias("word")).dropna().limit(MOST_COMMON_WORDS + 1).collect()
    if len(rows) > MOST_COMMON_WORDS:
        raise ValueError(f"more than {MOST_COMMON_WORDS} common words")
    sets: dict[str, set[str]] = {}
    for lang, word in rows:
        sets.setdefault(lang, set()).add(word)
    return {k: frozenset(v) for k, v in sets.items()} | {"": frozenset().union(*sets.values())}


def text_statistics(docs: DataFrame, common_words: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """row, row_id, lang_key, state (0 null, 1 blank, 2 text) and stats of every row of docs, written to the shared folder.

    Null, empty and blank texts have zeros. Repeated rows and repeated ids stay
    separate rows (``row`` is unique). lang_key is the language of common_words
    that the row names (``language_key``), '' where it names none; such a row's
    common words are those of any language.
    """
    common = common_sets(common_words)
    text = docs[text_col].cast("string")
    lang = language_key(docs[lang_col], [k for k in common if k]) if lang_col else F.lit("")
    state = F.when(text.isNull(), 0).when(text.rlike(r"(?U)\S"), 2).otherwise(1).cast("byte")
    rows = docs.select(docs[id_col].alias("row_id"), lang.alias("lang_key"), state.alias("state"), cleaned(text).alias("text"))
    schema = T.StructType(
        [T.StructField("row", T.LongType()), T.StructField("row_id", rows.schema["row_id"].dataType), T.StructField("lang_key", T.StringType()), T.StructField("state", T.ByteType()), T.StructField("stats", T.ArrayType(T.DoubleType()))]
    )
    return table_cut(rows.mapInArrow(lambda it: _statistics(it, common, block_bytes), schema), "text-statistics")


def exact_ranks(values: DataFrame, group: list[str], value: str, count: str, partitions: int | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Of each distinct (group, value) with its count: the rows of the group below it, up to it, and in all.

    The distinct values are range-partitioned by (group, value) and sorted; a
    partition's running counts become ranks by adding the counts of the
    partitions before it, of which there is one figure per partition and group.
    The columns of keep go along.
    """
    spark = values.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = values.repartitionByRange(n, *group, value).sortWithinPartitions(*group, value).withColumn("part", F.spark_partition_id())
    placed = table_cut(placed, "ranges")
    sums = placed.groupBy(*group, "part").agg(F.sum(count).alias("part_n"))
    by_group = Window.partitionBy(*group)
    offsets = sums.select(
        *group, "part",
        F.coalesce(F.sum("part_n").over(by_group.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"),
        F.sum("part_n").over(by_group).alias("n_all"),
    )
    running = placed.withColumn("in_part", F.sum(count).over(Window.partitionBy(*group, "part").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)))
    return running.join(offsets, [*group, "part"]).select(
        *group, value, count, *keep, (F.col("before") + F.col("in_part") - F.col(count)).alias("n_below"), (F.col("before") + F.col("in_part")).alias("n_upto"), "n_all"
    )


def tail_nats(stats: DataFrame, tails: dict[str, str] | None = None, hot_share: float = 0.005) -> DataFrame:
    """row and nats: of every text and statistic of ``tails``, -ln of the empirical tail probability within the language.

    The tail of a value x is P(X >= x) on the right and P(X <= x) on the left;
    'both' takes the smaller, doubled and at most 1. Every language is ranked by
    itself, whatever its size, and texts with equal statistics count once, so that
    a text doesn't become usual by being copied. Rows without text have no nats
    and take no part in the ranks; a language's only text has zeros.

    Values that many rows share (zeros, mostly) are joined by broadcast: a share
    of at least hot_share of a language leaves at most 1 / hot_share of them a
    language and statistic.
    """
    tails = tails or TAILS
    index, sides = {name: k for k, name in enumerate(STATISTICS)}, list(tails.values())
    rows = stats.where("state = 2").select("row", "lang_key", F.array(*[F.col("stats")[index[name]] for name in tails]).alias("x"))
    pairs = F.transform("x", lambda v, k: F.struct(k.alias("k"), v.alias("v")))
    # a hash of 64 bits stands for the statistics
    different = rows.groupBy("lang_key", F.xxhash64("x").alias("h")).agg(F.first("x").alias("x"), F.count("*").alias("n_rows"))
    counts = different.select("lang_key", "n_rows", F.inline(pairs)).groupBy("lang_key", "k", "v").agg(F.count("*").alias("n"), F.sum("n_rows").alias("n_rows"))
    ranks = exact_ranks(counts, ["lang_key", "k"], "v", "n", keep=("n_rows",))
    # as many rows as languages
    sizes = rows.groupBy("lang_key").agg(F.count("*").alias("n_lang"))
    right, left = (F.col("n_all") - F.col("n_below")) / F.col("n_all"), F.col("n_upto") / F.col("n_all")
    of = lambda side: F.col("k").isin([k for k, s in enumerate(sides) if s == side])
    tail = F.when(of("right"), right).when(of("left"), left).otherwise(F.least(2 * right, 2 * left, F.lit(1.0)))
    ranks = ranks.join(F.broadcast(sizes), "lang_key").select("lang_key", "k", "v", (F.col("n_rows") >= hot_share * F.col("n_lang")).alias("hot"), (-F.log(tail)).alias("nats"))
    ranks, on = table_cut(ranks, "ranks"), ["lang_key", "k", "v"]
    long = rows.select("row", "lang_key", F.inline(pairs))
    first = long.join(F.broadcast(ranks.where("hot").select(*on, F.col("nats").alias("hot_nats"))), on, "left")
    known = first.where("hot_nats is not null").select("row", "k", F.col("hot_nats").alias("nats"))
    rest = first.where("hot_nats is null").drop("hot_nats").join(ranks.where("not hot").select(*on, "nats"), on).select("row", "k", "nats")
    by_row = [F.coalesce(F.sum(F.when(F.col("k") == k, F.col("nats"))), F.lit(0.0)) for k in range(len(tails))]
    return known.unionByName(rest).groupBy("row").agg(F.array(*by_row).alias("nats"))


def fit_weights(nats: np.ndarray, odd: np.ndarray, prior: list[float] | None = None, strength: float = 1.0) -> np.ndarray:
    """Weights, and what is added to the weighted sum, of a logistic regression of ``odd`` on ``nats``.

    Deviations of the weights from the prior cost strength times their square / 2
    (of what is added, a thousandth of that), so few labels move them little, and
    none leave them as they are.
    """
    prior = np.asarray(PRIOR if prior is None else prior, float)
    x, w = np.c_[nats.reshape(-1, len(prior) - 1), np.ones(len(odd))], prior.copy()
    cost = np.append(np.full(len(prior) - 1, strength), strength / 1000)
    for _ in range(100 if len(odd) else 0):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
        slope = x.T @ (p - odd) + cost * (w - prior)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(cost), slope)
        w -= step * min(1.0, 5 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-9:
            break
    return w


def label_sample(labels: DataFrame, id_col: str = "doc_id", label_col: str = "label", most: int = MOST_LABELLED) -> DataFrame:
    """(id, odd) of at most ``most`` labelled documents, those of the least hash; odd is whether the label isn't 'prose'. Null ids and labels are left out."""
    rows = labels.select(F.col(id_col).alias("label_id"), (F.col(label_col) != "prose").alias("odd")).dropna().dropDuplicates(["label_id"])
    return rows.orderBy(F.xxhash64("label_id"), "label_id").limit(most)


def scored_statistics(docs: DataFrame, common_words: DataFrame, labels: DataFrame | None = None, most_labelled: int = MOST_LABELLED, **columns) -> DataFrame:
    """row_id, state, every statistic by name, and outlier_score: the weighted sum of the tails' nats (null without text).

    A score of 0 is where prose and the rest are equally likely among the labelled
    documents, and a score of s is odds of exp(s). labels has doc_id and label;
    without it the prior weights hold.
    """
    stats = text_statistics(docs, common_words, **columns)
    nats = table_cut(tail_nats(stats), "nats")
    x, odd = np.zeros((0, len(TAILS))), np.zeros(0)
    if labels is not None:
        sample = F.broadcast(label_sample(labels, most=most_labelled))
        known = stats.where("state = 2").join(sample, F.col("row_id") == F.col("label_id")).select("row", "odd").join(nats, "row").select("nats", "odd").limit(most_labelled).toPandas()
        if len(known):
            x, odd = np.stack(known["nats"].to_list()), known["odd"].to_numpy(float)
    w = fit_weights(x, odd)
    score = sum((F.col("nats")[k] * float(w[k]) for k in range(len(TAILS))), F.lit(float(w[-1])))
    named = [F.when(F.col("state") > 0, F.col("stats")[k]).alias(name) for k, name in enumerate(STATISTICS)]
    return stats.join(nats, "row", "left").select("row_id", "state", *named, score.alias("outlier_score"))


def not_prose(docs: DataFrame, common_words: DataFrame, labels: DataFrame | None = None, least_score: float = 0.5, most_labelled: int = MOST_LABELLED, **columns) -> DataFrame:
    """row_id and outlier_score of the texts whose outlier score is at least least_score.

    The bound lies above 0 because labelled documents are more often odd than
    documents are. Null, empty and blank texts are never found.
    """
    return scored_statistics(docs, common_words, labels, most_labelled, **columns).where(F.col("outlier_score") >= least_score).select("row_id", "outlier_score")

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from textguard.llm import collocations as CO

SCHEMA = "lang string, text string"


def slow_phrases(rows, longest):
    counts, totals = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            words = [w for w in re.split(r"[\x20\x09]+", piece) if w]
            totals[lang] += len(words)
            for size in range(1, longest + 1):
                for i in range(len(words) - size + 1):
                    counts[lang, tuple(words[i : i + size])] += 1
    return counts, totals


def slow_collocations(rows, least=10, longest=3, most=2000):
    counts, totals = slow_phrases(rows, longest)
    candidates = {k: a for k, a in counts.items() if a >= least and len(k[1]) > 1}
    out = {}
    for (lang, words), a in candidates.items():
        covered = any(
            other[0] == lang and len(other[1]) > len(words) and 100 * n >= 50 * a
            and any(other[1][i : i + len(words)] == words for i in range(len(other[1])))
            for other, n in candidates.items()
        )
        if covered:
            continue
        cuts = []
        for k in range(1, len(words)):
            l, r = counts[lang, words[:k]], counts[lang, words[k:]]  # noqa: E741
            cuts.append((1000000 * a * a // (l * r), k, l, r))
        score, _, l, r = min(cuts)  # noqa: E741
        out.setdefault(lang, []).append((" ".join(words), a, l, r, totals[lang], score))
    done = []
    for lang, found in out.items():
        found.sort(key=lambda x: (-x[5], -x[1], x[0].encode()))
        done += [(lang, n, *x) for n, x in enumerate(found[:most], 1)]
    return sorted(done)


def made_rows():
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(12)] + ["Ünï", "a b", "x\x1cy", "日本", "THE", "the", "tHe"]
    weights = [1 / (i + 1) for i in range(len(vocabulary))]
    rows = []
    for n in range(260):
        words = rng.choices(vocabulary, weights, k=rng.randint(0, 40))
        text = "".join(w + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "!?", "\r\n", "\v", " ; "]) for w in words)
        if n % 3 == 0:
            text += " New York City hall."
        if n % 5 == 0:
            text = "stock market " + text + " stock market"
        rows.append((["en"] * 6 + ["de", None, "und", ""])[n % 10 :][:1] + [text])
    rows = [tuple(r) for r in rows]
    rows += [("en", None), ("en", ""), (None, None), ("xx", " \t\n"), ("yy", "lone"), ("en", "go " * 30), ("en", "go")] * 2
    rows += [("zz", "b" * 300 + " " + "c" * 300 + ".")] * 12 + [("zz", "d " + "b" * 300)] * 11
    return rows


def run(spark, rows, **settings):
    frame = spark.createDataFrame(rows, SCHEMA).repartition(6)
    return sorted(tuple(r) for r in CO.collocations(frame, **settings).collect())


def test_collocations_match_the_plain_counts(spark):
    rows = made_rows()
    want = slow_collocations(rows)
    assert run(spark, rows) == want
    assert {r[0] for r in want} >= {"en", "und", "zz"} and any(" " in r[2].replace(" ", "", 1) for r in want)


@pytest.mark.parametrize("head_words,head_phrases", [(8, 5), (0, 0), (1000, 6), (9, 1000)])
def test_phrases_beyond_the_heads_are_counted_too(spark, head_words, head_phrases):
    rows = made_rows()
    got = run(spark, rows, head_words=head_words, head_phrases=head_phrases, longest=3)
    assert got == slow_collocations(rows)


@pytest.mark.parametrize("settings", [{"longest": 4}, {"longest": 4, "head_words": 9, "head_phrases": 7}, {"longest": 2, "least": 3, "most": 7}])
def test_other_lengths_and_limits(spark, settings):
    rows = made_rows()
    plain = {k: v for k, v in settings.items() if not k.startswith("head")}
    assert run(spark, rows, **settings) == slow_collocations(rows, **plain)


def test_small_tiles_and_windows(spark, monkeypatch):
    """Tiles of two by two, some dense, and windows of a few bytes, inside this process."""
    rows = made_rows()
    for name, value in (("SIDE_BITS", 1), ("DENSE_FROM", 2), ("WINDOW_BYTES", 16)):
        monkeypatch.setattr(CO, name, value)
    rng = np.random.default_rng(1)
    a, b = rng.zipf(1.5, 5000) % 40, rng.zipf(1.5, 5000) % 40
    found, counts = CO.tiled_counts(CO.addresses(a, b))
    want = Counter(zip(a.tolist(), b.tolist(), strict=True))
    frame = spark.createDataFrame([(int(f), int(c)) for f, c in zip(found, counts, strict=True)], "address bigint, n bigint")
    first, second = CO.ids_at(frame.address)
    assert {(r.a, r.b): r.n for r in frame.select(first.alias("a"), second.alias("b"), "n").collect()} == want
    texts = pa.array([text for _, text in rows])
    pairs, total = Counter(), 0
    for words in CO.words_in(texts):
        names = [words.distinct[int(i)].as_py() for i in words.index]
        total += len(names)
        pairs.update((x, y) for x, y, j in zip(names, names[1:], words.joined, strict=False) if j)
    counts, totals = slow_phrases([("l", text) for _, text in rows], 2)
    assert total == totals["l"] and pairs == {k[1]: n for k, n in counts.items() if len(k[1]) == 2}


def test_ids_rise_with_falling_counts(spark):
    rows = [("en", "a", 5), ("de", "c", 9), ("en", "z", 7), ("de", "b", 9), ("en", "y", 7)]
    frame = spark.createDataFrame(rows, "lang string, phrase string, n bigint").repartition(3)
    assert {r.phrase: r.id for r in CO.with_ids(frame, "ids").collect()} == {"b": 0, "c": 1, "y": 2, "z": 3, "a": 4}


def test_scores_are_exact_beyond_64_bits(spark):
    big = 4_000_000_000_000_007
    rows = [("en", "a", 1, big + 5), ("en", "b", 1, big + 11), ("en", "a b", 2, big), ("en", "c", 1, 3 * big), ("en", "a b c", 3, big - 3), ("en", "b c", 2, big)]
    frame = spark.createDataFrame(rows, "lang string, phrase string, length int, n bigint")
    got = {r.phrase: (r.score, r.l, r.r) for r in CO.scored(frame).collect()}
    exact = lambda a, l, r: 1000000 * a * a // (l * r)  # noqa: E731, E741
    assert got["a b"] == (exact(big, big + 5, big + 11), big + 5, big + 11)
    assert got["a b c"] == min(
        ((exact(big - 3, l, r), l, r) for l, r in ((big + 5, big), (big, 3 * big))), key=lambda x: x[0]  # noqa: E741
    )


def test_empty_tables_and_other_columns(spark):
    frame = spark.createDataFrame([("en", "ice cream. " * 12, "x", 1, 2)], SCHEMA + ", `odd.name` string, n bigint, phrase int")
    assert [tuple(r) for r in CO.collocations(frame).collect()] == [("en", 1, "ice cream", 12, 12, 12, 24, 1000000)]
    assert CO.collocations(frame.limit(0)).count() == 0
    assert CO.collocations(spark.createDataFrame([(None, None), ("en", "few words")], SCHEMA)).count() == 0


def test_a_long_text_is_read_in_windows():
    text = "one two. " * 700_000 + "three " * 10 + "x" * 5_000_000 + " four"
    sizes = [len(w.index) for w in CO.words_in(pa.array([None, text, ""]))]
    assert len(sizes) > 1 and sum(sizes) == 1_400_012

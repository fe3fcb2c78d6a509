import random

import numpy as np
import pyarrow as pa

from textguard.llm import repeats
from textguard.llm.words import words_of

NO_ID = -(1 << 63)


def brute(rows):
    split = [(NO_ID if doc is None else doc, (text or "").encode().split()) for doc, text in rows]
    least = {}
    for doc, words in split:
        for i in range(len(words) - 49):
            window = tuple(words[i : i + 50])
            least[window] = min(doc, least.get(window, doc))
    out = []
    for doc, words in split:
        gone = set()
        for i in range(len(words) - 49):
            if least[tuple(words[i : i + 50])] < doc:
                gone.update(range(i, i + 50))
        out.append((doc, len(words), len(gone), b" ".join(w for i, w in enumerate(words) if i not in gone).decode()))
    return sorted(out)


def documents(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)] + ["the"] * 150 + ["é", "of"] * 50
    prose = lambda n: [rng.choice(words) for _ in range(n)]
    passages = [prose(n) for n in (49, 50, 51, 60, 120, 400)]
    periodic = (["a"] * 70, ["a", "b"] * 60, ["x", "y", "z"] * 50, ["a"] * 16 + ["q"], ["a"] * 300)
    rows = []
    for doc in range(70):
        text = []
        for _ in range(rng.randint(0, 4)):
            text += prose(rng.randint(0, 60)) + rng.choice([*passages, *periodic])
            if rng.random() < 0.2:
                cut = rng.randrange(len(text))
                text[cut] = "changed"
        rows.append((doc, rng.choice(" \n\t").join(text + prose(rng.randint(0, 30)))))
    whole = rows[5][1]
    rows += [(200 + i, whole) for i in range(20)] + [(None, whole), (3, rows[4][1]), (7, " ".join(passages[4] * 2))]
    return rows + [(300, None), (301, ""), (302, " ".join(passages[4] * 3)), (302, " ".join(passages[4] * 3)), (303, " ".join(prose(9000)))]


def test_removal_matches_brute_force(spark):
    for seed in (1, 2, 3):
        rows = documents(seed)
        done = repeats.drop_repeats(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(6))
        found = sorted((NO_ID if r.doc_id is None else r.doc_id, r.n_words, r.n_removed, r.text) for r in done.collect())
        changed = [r for r in found if not r[2]]
        want = brute(rows)
        # untouched texts keep their words too, joined by one space
        assert [r for r in found if r[2]] == [r for r in want if r[2]] and len(changed) < len(found)
        assert found == want


def test_equal_windows_have_equal_anchors():
    texts = [text or "" for _, text in documents(4)]
    flat, bounds = words_of(pa.array(texts))
    words = flat.to_pylist()
    parse = repeats.recompressed(repeats.word_names(flat, 0), bounds)
    owner = repeats.anchors(parse, len(words))
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    seen, owned, total = {}, 0, 0
    for p in range(len(words) - 49):
        if p + 50 > bounds[row[p] + 1]:
            continue
        symbol = owner[p]
        anchor = (int(parse.name[symbol]), int(parse.start[symbol] - p)) if symbol >= 0 else None
        assert seen.setdefault(tuple(words[p : p + 50]), anchor) == anchor
        owned += symbol >= 0
        total += 1
    assert owned > 0.99 * total
    for symbol in range(len(parse.name)):
        spelled = tuple(words[parse.start[symbol] : parse.stop[symbol]])
        assert seen.setdefault(("name", int(parse.name[symbol])), spelled) == spelled


def test_columns_and_empty_table(spark):
    text = " ".join(f"w{i}" for i in range(60))
    frame = spark.createDataFrame([(1, text, "a", 5), (2, text, "b", 6)], "doc_id bigint, text string, spans string, doc int")
    done = repeats.drop_repeats(frame)
    assert done.columns == ["doc_id", "spans", "doc", "text", "n_words", "n_removed"]
    assert sorted((r.doc, r.n_removed) for r in done.collect()) == [(5, 0), (6, 60)]
    assert repeats.drop_repeats(frame.limit(0)).count() == 0


def test_names_with_dots(spark):
    rows = spark.createDataFrame([(1, "a b", 7)], ["doc_id", "text", "a.b"])
    assert repeats.drop_repeats(rows).first()["a.b"] == 7

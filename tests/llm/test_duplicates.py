import random
import time
from collections import Counter, defaultdict

import numpy as np
import pytest

from plumbline.llm import decontaminate, jaccard_join, line_dedup, substring_dedup
from plumbline.llm import words as W
from plumbline.llm.components import components
from tests.llm import cases


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(cases.rows(), cases.COLUMNS).repartition(3).cache()


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame(cases.ITEMS, "item_id long, text string")


def distance(p, s):
    """Smallest edit distance of p to a part of s."""
    before = [0] * (len(s) + 1)
    for i, c in enumerate(p, 1):
        now = [i]
        for j, d in enumerate(s, 1):
            now.append(min(before[j] + 1, now[-1] + 1, before[j - 1] + (c != d)))
        before = now
    return min(before)


def test_decontamination(spark, docs, items):
    got = Counter((r["doc_id"], r["item_id"], r["distance"]) for r in decontaminate.matches(docs, items).collect())
    want = Counter()
    for i, t, *_ in cases.rows():
        text = decontaminate.normal(t)
        for k, q in cases.ITEMS:
            q = decontaminate.normal(q)
            if q and len(text) < 5000 and (d := distance(q, text)) <= int(decontaminate.RATE * len(q)) and int(decontaminate.RATE * len(q)):
                want[i, k, d] += 1
    assert got == want and (12, 1, 1) in want and (11, 1, 0) in want
    dirty = {i for i, *_ in want}
    kept = decontaminate.clean(docs, items)
    assert kept.columns == docs.columns
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter(i for i, *_ in cases.rows() if i not in dirty)
    for d, q in ((docs.limit(0), items), (docs, items.limit(0))):
        assert decontaminate.matches(d, q).count() == 0
    assert decontaminate.clean(docs, items.limit(0)).count() == docs.count()


def test_items_in_blocks(docs, items, monkeypatch):
    whole = Counter(map(tuple, decontaminate.matches(docs, items).collect()))
    monkeypatch.setattr(decontaminate.item_blocks, "__defaults__", (60,))
    assert Counter(map(tuple, decontaminate.matches(docs, items).collect())) == whole


def classes(rows, threshold=0.8):
    sets = [cases.shingles(t) for _, t, *_ in rows]
    links = [[j for j in range(len(rows)) if j != i and sets[i] and cases.jaccard(sets[i], sets[j]) >= threshold] for i in range(len(rows))]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, own in enumerate(links):
        for j in own:
            root[find(i)] = find(j)
    members = defaultdict(list)
    for i in range(len(rows)):
        members[find(i)].append(rows[i][0])
    name = {k: min((x for x in v if x is not None), default=None) for k, v in members.items()}
    return Counter((rows[i][0], name[find(i)], len(links[i])) for i in range(len(rows)))


def test_jaccard_join(spark, docs):
    got = Counter((r["doc_id"], r["class_id"], r["n_links"]) for r in jaccard_join.similar(docs).collect())
    assert got == classes(cases.rows())
    assert jaccard_join.similar(docs.limit(0)).count() == 0


def test_jaccard_join_over_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK", 8)
    base = cases.prose(50, 120).split(" ")
    rows = [(i, " ".join([*base[:i], f"new{i}", *base[i + 1 :]])) for i in range(40)] + [(100 + i, cases.prose(i, 60)) for i in range(20)]
    got = Counter((r["doc_id"], r["class_id"], r["n_links"]) for r in jaccard_join.similar(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == classes(rows)


def test_one_of_each(spark, docs):
    kept = jaccard_join.one_of_each(docs)
    assert kept.columns == docs.columns
    ids = Counter(r["doc_id"] for r in kept.collect())
    assert ids[0] == 1 and ids[1] == 0 and ids[2] == 0 and ids[8] == 1 and ids[3] == 1 and ids[4] == 1 and ids[None] == 1
    plain = docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    again = Counter(r["doc_id"] for r in jaccard_join.one_of_each(plain).collect())
    assert again == Counter({k: v for k, v in ids.items() if k is not None})
    assert jaccard_join.one_of_each(docs.limit(0)).count() == 0


def test_components(spark):
    chain = [(i, i + 1) for i in range(30)] + [(50, 40), (40, 50), (60, 60)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 31)} | {50: 40}


def line_chunks(lines):
    """First line and end of the chunks of all cuts that have two lines or more and a word."""

    def h(b):
        return int(W.span_hashes(np.frombuffer(b, np.uint8), np.array([0]), np.array([len(b)]))[0]) if b else 0

    hashes, out = [h(x) for x in lines], set()
    for k in range(line_dedup.CUTS):
        begin, ended = 0, False
        for i in range(len(lines)):
            rolling = sum(hashes[i - j] * int(W._PLACE[j]) for j in range(line_dedup.WINDOW) if i >= j) + int(W._PLACE[line_dedup.WINDOW + k])
            ended = i > 0 and not ended and int(W.mix(np.array([rolling % 2**64], np.uint64))[0]) % line_dedup.LINES == 0
            if ended or i == len(lines) - 1:
                if i > begin and b"".join(lines[begin : i + 1]).split():
                    out.add((begin, i + 1))
                begin = i + 1
    return out


def test_line_dedup(docs):
    got = Counter((r["doc_id"], r["removed_lines"], r["text"]) for r in line_dedup.dedup(docs).select("doc_id", "removed_lines", "text").collect())
    import pyspark.sql.functions as F

    order = {(r["doc_id"], r["text"]): r["t"] for r in docs.select("doc_id", "text", F.xxhash64("text").alias("t")).collect()}
    distinct = sorted({(i, t) for i, t, *_ in cases.rows()}, key=lambda x: (x[0] is not None, x[0] or 0, order[x]))
    lines = {x: x[1].encode().split(b"\n") if x[1] is not None else [] for x in distinct}
    first, done = {}, {}
    for x in distinct:
        for a, b in sorted(line_chunks(lines[x])):
            first.setdefault(tuple(lines[x][a:b]), (x, a))
    for x in distinct:
        own, gone = lines[x], set()
        for a, b in line_chunks(own):
            y, c = first[tuple(own[a:b])]
            if x == y and a < c + b - a:
                continue
            k = n = 0
            while k < line_dedup.REACH and a - k > 0 and c - k > 0 and own[a - k - 1] == lines[y][c - k - 1]:
                k += 1
            while n < line_dedup.REACH and b + n < len(own) and c + b - a + n < len(lines[y]) and own[b + n] == lines[y][c + b - a + n]:
                n += 1
            gone |= set(range(a - k, b + n))
        done[x] = len(gone), x[1] and b"\n".join(z for i, z in enumerate(own) if i not in gone).decode()
    assert got == Counter((i, *done[i, t]) for i, t, *_ in cases.rows())
    assert sum(n for _, n, _ in got) > 30
    assert line_dedup.dedup(docs).columns == [*docs.columns, "removed_lines"]
    assert line_dedup.dedup(docs.limit(0)).count() == 0


def test_compact_windows_hold_every_passage_once():
    rng = np.random.default_rng(5)
    for n, least in ((60, 7), (5, 5), (4, 5), (33, 1)):
        value = rng.integers(0, 2**64, n, dtype=np.uint64)
        low, centre, high = substring_dedup.compact_windows(value, np.array([0, n]), least)
        top = value >> np.uint64(n.bit_length())
        for a in range(n):
            for b in range(a + least, n + 1):
                held = [c for lo, c, hi in zip(low, centre, high, strict=True) if lo <= a <= c < b <= hi]
                assert held == [a + int(np.argmin(top[a:b]))]


def test_repeated_passages(spark, docs):
    got = substring_dedup.repeated_passages(docs).collect()
    text = {i: cases.words(t) for i, t, *_ in cases.rows() if i is not None}
    pairs = set()
    for r in got:
        assert r["similarity"] >= 0.8 and r["end_word"] - r["begin_word"] >= 50
        if r["doc_id"] is not None and r["other_id"] is not None:
            a, b = text[r["doc_id"]][r["begin_word"] : r["end_word"]], text[r["other_id"]][r["other_begin"] : r["other_end"]]
            assert cases.jaccard(cases.shingles(" ".join(a)), cases.shingles(" ".join(b))) == pytest.approx(r["similarity"])
            pairs.add(frozenset((r["doc_id"], r["other_id"])))
    assert frozenset((9, 10)) in pairs and {0, 1, 2} <= {x for p in pairs for x in p}
    assert not {x for p in pairs for x in p} & {8, 11, 12, 17}
    assert substring_dedup.repeated_passages(docs.limit(0)).count() == 0


def test_no_repeated_passage_is_missed(spark):
    rows, shared = [], [cases.prose(900 + k, 55) for k in range(6)]
    for i in range(60):
        rows.append((i, f"{cases.prose(i, 40 + i)} {shared[i % 6]} {cases.prose(300 + i, 30)}" if i % 2 else cases.prose(600 + i, 150)))
    got = substring_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string"), substring_dedup.Passages(chunk=40)).collect()
    root = {i: i for i in range(60)}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for r in got:
        root[find(r["doc_id"])] = find(r["other_id"])
    groups = defaultdict(set)
    for i in range(60):
        groups[find(i)].add(i)
    assert sorted(map(sorted, (g for g in groups.values() if len(g) > 1))) == sorted(sorted(i for i in range(60) if i % 2 and i % 6 == k) for k in (1, 3, 5))


def test_passages_with_an_inserted_or_deleted_word(spark):
    rows = []
    for k in range(40):
        q = cases.prose(2000 + k, (60, 75, 90)[k % 3]).split()
        m = len(q) // 2
        other = [*q[:m], f"new{k}", *q[m:]] if k % 2 else [*q[:m], *q[m + 1 :]]
        rows += [(2 * k, f"{cases.prose(3000 + k, 40)} {' '.join(q)}"), (2 * k + 1, f"{cases.prose(4000 + k, 20)} {' '.join(other)} {cases.prose(5000 + k, 30)}")]
    got = substring_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all(r["similarity"] >= 0.8 for r in got)
    # before, a passage under 100 words with such an edit in its middle was never found
    assert len({min(r["doc_id"], r["other_id"]) for r in got if r["doc_id"] // 2 == r["other_id"] // 2}) >= 28


def test_documents_that_share_a_part_do_not_split_a_group(spark):
    for g in (1, 4):
        q = cases.prose(7000 + g, 55).split()
        rows = [(i, f"{cases.prose(10**5 * g + i, 30 + i)} {' '.join(q)} {cases.prose(10**5 * g + 500 + i, 40)}") for i in range(30)]
        for i in range(30):
            at = i * 7 % 25
            rows.append((100 + i, f"{cases.prose(10**5 * g + 1000 + i, 50)} {' '.join(q[at : at + 30])} {cases.prose(10**5 * g + 2000 + i, 50)}"))
        rows.sort(key=lambda x: hash((x[0], g)) % 1009)
        got = substring_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(1)).collect()
        root = list(range(200))

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for r in got:
            root[find(r["doc_id"])] = find(r["other_id"])
        assert len({find(i) for i in range(30)}) == 1
        assert all(find(100 + i) == 100 + i for i in range(30))


def test_a_substituted_word_loses_no_short_passage(spark):
    rows = []
    for k in range(80):
        q = cases.prose(20_000 + k, 52).split()
        other = [*q[:26], f"new{k}", *q[27:]]  # similarity 43 / 53
        rows += [(2 * k, f"{cases.prose(30_000 + k, 40)} {' '.join(q)}"), (2 * k + 1, f"{cases.prose(40_000 + k, 20)} {' '.join(other)} {cases.prose(50_000 + k, 30)}")]
    got = substring_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {min(r["doc_id"], r["other_id"]) for r in got if r["doc_id"] // 2 == r["other_id"] // 2} == set(range(0, 160, 2))


def test_whole_repeated_blocks_of_lines_go(spark):
    def line(k):
        return cases.prose(60_000 + k, 6).replace("\n", " ")

    rows = []
    for k in range(30):
        block = [line(1000 * k + i) for i in range(2 + k % 5)]
        for half in (0, 1):
            rows.append((2 * k + half, "\n".join([line(1000 * k + 100 + 50 * half + i) for i in range(1 + k % 3)] + block + [line(1000 * k + 300 + 50 * half + i) for i in range(2)])))
    rows += [(100, "x y\nx y\nx y\nx y"), (101, "x y\nother"), (102, None), (103, "")]
    got = {r["doc_id"]: r for r in line_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string"), extend=True).collect()}
    for i, t in rows[:60]:
        lines, n = t.split("\n"), 2 + i // 2 % 5 if i % 2 else 0
        at = 1 + i // 2 % 3
        assert (got[i]["removed_lines"], got[i]["text"]) == (n, "\n".join(lines[:at] + lines[at + n :]))
    assert (got[100]["removed_lines"], got[100]["text"]) == (2, "x y\nx y")
    assert [(got[i]["removed_lines"], got[i]["text"]) for i in (101, 102, 103)] == [(0, "x y\nother"), (0, None), (0, "")]


def test_one_of_each_where_a_shared_doc_id_heads_one_class_alone(spark):
    near = cases.prose(70, 120).split(" ")
    near[60] = "changed"
    rows = [(3, cases.prose(70, 120)), (5, cases.prose(71, 120)), (5, " ".join(near))]
    kept = jaccard_join.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["text"]) for r in kept) == sorted(rows[:2])


def test_near_passages_against_all_pairs_of_windows(spark):
    """Recall over passages of 50 to 300 words with inserted, deleted and changed words, of which some are quoted in part elsewhere."""
    r = random.Random(3)
    rows, want, k = [], {}, 0
    for n in (50, 60, 75, 100, 150, 300):
        made = 0
        while made < 25:
            k += 1
            q = cases.prose(10**6 + k, n).split()
            other = list(q)
            for _ in range(r.randint(1, max(1, n // 45))):
                at, kind = r.randrange(len(other)), r.choice("sid")
                if kind == "d":
                    del other[at]
                else:
                    other[at : at + (kind == "s")] = [f"x{r.random()}"]
            if len(other) < 50 or cases.jaccard(cases.shingles(" ".join(q)), cases.shingles(" ".join(other))) < 0.8:
                continue
            for m, own in enumerate((q, other, q[5:35])):
                rows.append((3 * k + m, f"{cases.prose(10**7 * (m + 1) + k, r.randint(0, 90))} {' '.join(own)} {cases.prose(10**8 * (m + 1) + k, r.randint(0, 60))}"))
            want[k] = n
            made += 1
    tokens = {i: [tuple(w[x : x + 5]) for x in range(len(w) - 4)] for i, t in rows for w in [t.split()]}

    def similar(a, b):
        """Whether any passages of 50 words are similar, or longer ones of equal length."""
        if not set(a) & set(b):
            return False
        for n in (46, 71, 96):
            own = [set(b[y : y + n]) for y in range(len(b) - n + 1)]
            for x in range(len(a) - n + 1):
                one = set(a[x : x + n])
                if any(len(one & two) * 5 >= 4 * len(one | two) for two in own):
                    return True
        return False

    got = {(min(x["doc_id"], x["other_id"]), max(x["doc_id"], x["other_id"])) for x in substring_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    pairs = {(3 * k + x, 3 * k + y) for k in want for x in range(3) for y in range(x)}
    pairs = {(min(p), max(p)) for p in pairs}
    assert got <= pairs  # nothing between passages that have no words in common
    true = {(a, b) for a, b in pairs if (a, b) in got or similar(tokens[a], tokens[b])}
    assert len(got & true) >= 0.97 * len(true) and {(3 * k, 3 * k + 1) for k in want} <= true
    assert not any(b % 3 == 2 for _, b in got)  # quotes of 30 words are no passages


def test_a_hot_key_is_ordered_by_ranges(spark):
    """A line of 40 words in all texts, and passages around it that some of them share."""
    line = cases.prose(1, 40).replace("\n", " ")
    rows = [(i, f"{cases.prose(1000 + i, 30)} {line} {cases.prose(2000 + i, 30)}") for i in range(150)]
    rows += [(1000 + i, f"{cases.prose(3000 + i, 30)} {line} {cases.prose(4000 + i // 3, 30)}") for i in range(30)]
    for p in (substring_dedup.Passages(hot=4), substring_dedup.Passages(hot=4, chunk=50), substring_dedup.Passages()):
        got = substring_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), p).collect()
        pairs = {frozenset((x["doc_id"], x["other_id"])) for x in got}
        for i in range(0, 30, 3):
            assert len([q for q in pairs if q <= {1000 + i, 1001 + i, 1002 + i}]) >= 2
        assert all(len(q) == 2 for q in pairs)
        assert not [q for q in pairs if min(q) < 1000 or len({(x - 1000) // 3 for x in q}) > 1]


def test_items_without_a_budget_are_found_as_words_and_at_their_place(spark):
    docs = spark.createDataFrame([(1, "a x b"), (2, "axb"), (3, "X"), (4, "b, x!")], "doc_id long, text string")
    items = spark.createDataFrame([("q", "x"), ("none", "y")], "item_id string, text string")
    got = {r["doc_id"]: r for r in decontaminate.matches(docs, items).collect()}
    assert set(got) == {1, 3, 4}
    for i, t in ((1, "a x b"), (3, "X"), (4, "b, x!")):
        r = got[i]
        assert r["item_id"] == "q" and r["distance"] == 0 and decontaminate.normal(t)[r["begin"] : r["end"]] == "x"


def test_prefixes_are_shortened_until_each_text_has_the_recall():
    forest = jaccard_join.Forest()
    rng = np.random.default_rng(2)
    below = np.cumsum(rng.integers(0, 9, (200, forest.trees, forest.deepest - forest.least + 1))[:, :, ::-1], axis=2)[:, :, ::-1] + 1
    below[0] = 1
    depth = forest.depths(below)
    assert forest.least == 3 and depth.min() >= forest.least and depth.max() <= forest.deepest and len(np.unique(depth)) > 1
    met = 1 - np.prod(1 - forest.threshold**depth, axis=1)
    assert (met >= forest.recall).all()
    # the last prefix that was shortened was needed
    longer = np.log1p(-(forest.threshold ** depth.astype(float))).sum(axis=1) - np.log1p(-(forest.threshold**3)) + np.log1p(-(forest.threshold**4))
    assert (longer > np.log(1 - forest.recall)).mean() > 0.5


def test_rows_without_ids_take_linear_time(spark):
    rows = [(None, cases.prose(80_000 + i // 2, 30) + (" end" if i % 2 else "")) for i in range(4000)]
    began = time.perf_counter()
    got = jaccard_join.similar(spark.createDataFrame(rows, "doc_id long, text string")).groupBy("n_links").count().collect()
    assert {r["n_links"]: r["count"] for r in got} == {1: 4000} and time.perf_counter() - began < 60


def test_components_with_a_hub(spark, monkeypatch):
    monkeypatch.setattr("plumbline.llm.components.FEW", 5)
    links = [(0, i) for i in range(1, 60)] + [(100 + i, 101 + i) for i in range(9)] + [(59, 200)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in (*range(1, 60), 200)} | {i: 100 for i in range(101, 110)}


@pytest.mark.parametrize(("n", "edits"), [(100, 2), (300, 6)])
def test_edited_passages_are_told_whole(spark, n, edits):
    """Of passages with inserted, deleted and changed words the words in common are reported, beside an exact passage too, and not their equal part alone."""
    r, rows, spans = random.Random(n), [], {}
    for k in range(40):
        q, other = cases.prose(10**13 + 1000 * n + k, n).split(), []
        while not other or cases.jaccard(cases.shingles(" ".join(q)), cases.shingles(" ".join(other))) < 0.8:
            other = list(q)
            for _ in range(edits):
                at, kind = r.randrange(len(other)), r.choice("sid")
                other[at : at + (kind != "i")] = [] if kind == "d" else [f"x{r.random()}"]
        exact = cases.prose(10**8 + k, 70).split() if k % 2 else []
        for half, own in ((0, q), (1, other)):
            before = cases.prose(10**9 + 2 * k + half, r.randint(0, 60)).split()
            rows.append((2 * k + half, " ".join([*before, *own, *cases.prose(10**10 + 2 * k + half, 45).split(), *exact, *cases.prose(10**11 + 2 * k + half, 30).split()])))
            at = len(before)
            spans[2 * k + half] = [set(range(at, at + len(own)))] + ([set(range(at + len(own) + 45, at + len(own) + 115))] if exact else [])
    told = {i: set() for i in spans}
    for g in substring_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        assert g["doc_id"] // 2 == g["other_id"] // 2
        told[g["doc_id"]] |= set(range(g["begin_word"], g["end_word"]))
        told[g["other_id"]] |= set(range(g["other_begin"], g["other_end"]))
    share = [len(told[i] & own) / len(own) for i in spans for own in spans[i]]
    assert sum(x >= 0.9 for x in share) >= 0.95 * len(share)
    # nothing but the passages is told, except some words at their edges
    assert all(len(told[i] - set().union(*spans[i])) <= 12 for i in spans)


def test_flanks_tell_whether_texts_go_on_alike():
    rng = np.random.default_rng(4)
    a = rng.integers(1, 2**16, (6, substring_dedup._FLANK)).astype(np.uint16)
    b = a.copy()
    b[1, 3] ^= 1  # one word differs
    b[2, 3:] = rng.integers(1, 2**16, substring_dedup._FLANK - 3)  # nothing in common behind it
    b[3, 4:] = a[3, 3:-1]  # a word inserted
    b[4, 5:-1] = a[4, 6:]  # a word deleted
    a[5, 2:] = b[5, 2:] = 0  # both texts end
    equal, again = substring_dedup._goes_on(a, b, 5)
    assert equal.tolist() == [substring_dedup._FLANK, 3, 3, equal[3], 5, 2] and equal[3] >= 4 and again.tolist() == [True, True, False, True, True, False]


def runs_of_lines(rows):
    """Numbers of the lines that stand in a pair of lines which stands before, by text."""
    first, gone = {}, defaultdict(set)
    for i, text in sorted(rows):
        lines = text.split("\n")
        for k, pair in enumerate(zip(lines, lines[1:])):
            if (pair[0] + pair[1]).strip():
                place = first.setdefault(pair, (i, k))
                if place != (i, k) and place != (i, k - 1):
                    gone[i] |= {k, k + 1}
    return gone


def test_chunks_take_most_of_the_runs_of_lines(spark):
    r = random.Random(9)
    line = lambda: cases.prose(r.randrange(10**12), 5).replace("\n", " ")
    blocks = [[line() for _ in range(2 + k % 9)] for k in range(60)]
    rows = []
    for i in range(200):
        text = []
        for _ in range(3):
            text += [line() for _ in range(r.randint(1, 4))] + (r.choice(blocks) if r.random() < 0.7 else [])
        rows.append((i, "\n".join(text)))
    want, texts = runs_of_lines(rows), dict(rows)
    got = {x["doc_id"]: x for x in line_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    removed = 0
    for i, text in rows:
        left, k = got[i]["text"].split("\n") if got[i]["text"] else [], 0
        for x in text.split("\n"):  # what is left stands in the text, in order
            k += k < len(left) and left[k] == x
        assert k == len(left) and got[i]["removed_lines"] == len(text.split("\n")) - len(left)
        removed += got[i]["removed_lines"]
        assert got[i]["removed_lines"] <= len(want[i])
    assert removed >= 0.9 * sum(map(len, want.values()))
    # one of each line stays
    assert {x for t in texts.values() for x in t.split("\n")} == {x for r_ in got.values() for x in r_["text"].split("\n") if r_["text"]}


def test_a_text_of_very_many_repeated_runs(spark):
    rows = [(1, "a b\nc d\ne f"), (2, "\n".join(f"own {i}\na b\nc d\ne f" for i in range(50_000)))]
    began = time.perf_counter()
    got = {x["doc_id"]: x for x in line_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert time.perf_counter() - began < 60 and got[1]["removed_lines"] == 0
    lines = got[2]["text"].split("\n")
    assert got[2]["removed_lines"] == 200_000 - len(lines) and got[2]["removed_lines"] >= 0.9 * 150_000 and [x for x in lines if x.startswith("own")] == [f"own {i}" for i in range(50_000)]


def test_extended_line_dedup_takes_every_run(spark):
    r = random.Random(12)
    line = lambda: r.choice(["", " ", "\t", *(f"w{k}" for k in range(12))])
    rows = [(i, "\n".join(line() for _ in range(r.randrange(40)))) for i in range(60)] + [(60, "a b\nc d\ne f"), (61, "\n".join(f"own {i}\na b\nc d\ne f" for i in range(20_000)))]
    want = runs_of_lines(rows)
    got = {x["doc_id"]: x for x in line_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), extend=True).collect()}
    for i, text in rows:
        assert (got[i]["removed_lines"], got[i]["text"]) == (len(want[i]), "\n".join(x for k, x in enumerate(text.split("\n")) if k not in want[i]))
    assert len(want[61]) == 60_000


def test_line_dedup_joins_small_tables_as_it_does_large_ones(spark):
    rows = [(i, f"a b\nc d\ne f\nown {i}") for i in range(20)]
    got = line_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string"), extend=True)
    plan = got._jdf.queryExecution().executedPlan().toString()
    # the growth of a small run tells of a large one
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
    assert [x["removed_lines"] for x in got.orderBy("doc_id").collect()] == [0] + [3] * 19


def test_few_runs_are_gone_through_as_many_are(monkeypatch):
    rng = np.random.default_rng(8)
    p = substring_dedup.Passages()
    a, b = [], []
    for _ in range(80):
        x = rng.integers(0, 2**63, rng.integers(60, 600)).astype(np.uint64)
        y = x.copy()
        hit = rng.random(len(y)) < rng.choice([0.0, 0.005, 0.02, 0.1])
        y[hit] = rng.integers(0, 2**63, hit.sum()).astype(np.uint64)
        a.append(x)
        b.append(np.delete(y, rng.integers(0, len(y), rng.integers(0, 3))))
    args = a, b, [[0]] * len(a), [False] * len(a), p
    few = substring_dedup.verify(*args)
    monkeypatch.setattr(substring_dedup, "_FEW", 0)
    assert few == substring_dedup.verify(*args) and len(few[0]) >= 60

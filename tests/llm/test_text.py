"""Line dedup, decontamination, n-gram join and token counts: brute force on small tables with every awkward case."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest

from waymark.llm import common
from waymark.llm.common import WordHashes
from waymark.llm.decontaminate import contamination
from waymark.llm.line_dedup import dedup_lines
from waymark.llm.ngram_join import near_duplicates, plan, shingle_set, signatures, tags
from waymark.llm.token_counts import attribute, count_tokens

SCHEMA = "doc_id long, text string, id string, node long, key string, n_lines int, spans string"


def docs(spark, rows, parts=3):
    return spark.createDataFrame([(i, t, "x", 1, "k", 2, "s") for i, t in rows], SCHEMA).repartition(parts)


def low(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t)


def brute_lines(rows):
    key = lambda x: low(x.strip(" \t\n\r\x0b\x0c"))
    held = defaultdict(list)
    for i, t in rows:
        for k in {key(x) for x in (t or "").split("\n")}:
            if len(k) >= 20:
                held[k].append(i)
    keeper = {k: max([i for i in ids if i is not None], default=None) for k, ids in held.items() if len(ids) >= 3}
    out = []
    for i, t in rows:
        all_ = (t or "").split("\n")
        kept = [x for x in all_ if key(x) not in keeper or keeper[key(x)] == i]
        out.append((i, len(all_), len(all_) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return out


def test_line_dedup(spark):
    rnd = random.Random(1)
    common = [f"This is the shared line number {i} ÉÀ" for i in range(30)]
    rows = [(i, "\n".join(rnd.choice([*common, f"own line of document {i} {rnd.random()}", "short", "", "  \t" + common[0].upper().replace("ÉÀ", "ÉÀ") + "\x0b "]) for _ in range(rnd.randint(0, 12)))) for i in range(200)]
    rows += [(None, common[1]), (None, "line that only null ids hold, twice"), (None, "line that only null ids hold, twice"), (None, "line that only null ids hold, twice"), (900, None), (901, ""), (902, "\n\n"), (903, (common[2] + "\n") * 20000), (3, common[3]), (3, common[3])]
    got = dedup_lines(docs(spark, rows), keep="largest")
    assert sorted(map(str, ((r.id, r.n_lines, r.n_dropped, r.kept_sha256) for r in got.collect()))) == sorted(map(str, brute_lines(rows)))
    # a filter so small that all lines are suspected changes nothing
    tight = dedup_lines(docs(spark, rows), keep="largest", bits=1 << 10)
    assert sorted(map(str, tight.drop("kept_text").collect())) == sorted(map(str, got.drop("kept_text").collect()))
    assert dedup_lines(docs(spark, [])).count() == 0


def test_line_dedup_by_shuffle(spark, monkeypatch):
    monkeypatch.setattr(common, "BROADCAST_BYTES", 0)
    rows = [(i, "the very same line of text\nand another one of these") for i in range(20)]
    got = dedup_lines(docs(spark, rows), keep="largest").collect()
    assert sorted((r.id, r.n_dropped) for r in got) == [(i, 2 if i < 19 else 0) for i in range(20)]


def brute_hits(rows, items, size=10):
    words = lambda t: [x for x in re.split("[\x00-\x2f\x3a-\x60\x7b-\x7f]+", low(t or "")) if x]
    wins = defaultdict(set)
    for name, t in items:
        w = words(t)
        for i in range(max(1, len(w) - size + 1) if w else 0):
            wins[tuple(w[i : i + size])].add(str(name))
    out = []
    for i, t in rows:
        w, hit, names = words(t), set(), set()
        for n in {len(x) for x in wins}:
            for k in range(len(w) - n + 1):
                if (x := tuple(w[k : k + n])) in wins:
                    hit |= set(range(k, k + n))
                    names |= wins[x]
        out.append((i, len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()))
    return out


@pytest.mark.parametrize("block_words", [1_000_000, 60])
def test_decontamination(spark, block_words):
    rnd = random.Random(2)
    vocabulary = ["the", "of", "Élan", "übung", "x1", "and", "word"] + [f"w{i}" for i in range(40)]
    say = lambda n: " ".join(rnd.choice(vocabulary) for _ in range(n))
    items = [(i, say(rnd.randint(11, 30))) for i in range(25)] + [(50, "only three words"), (51, "one"), (52, ""), (53, None), (3, say(12)), (54, "the the the the the the the the the the the the")]
    rows = [(i, say(40) + ", " + (rnd.choice(items)[1] or "") + "! " + say(20)) for i in range(60)]
    rows += [(100, None), (101, ""), (102, items[0][1].upper()), (103, "one"), (None, items[1][1]), (104, "the " * 500), (105, items[2][1].replace(" ", " -- ")), (7, "only three words"), (7, "only three words"), (106, say(30000))]
    bench = spark.createDataFrame([(i, t, "z") for i, t in items], "item_id long, text string, doc_id string")
    got = contamination(docs(spark, rows), bench, block_words=block_words).collect()
    assert sorted(map(str, ((r.id, r.n_words, r.n_hit, len(r["items"]), r.items_sha256) for r in got))) == sorted(map(str, brute_hits(rows, items)))


def test_decontamination_of_nothing(spark):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert [r.n_hit for r in contamination(docs(spark, [(1, "a b"), (2, None)]), bench).collect()] == [0, 0]
    full = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert contamination(docs(spark, []), full).count() == 0


def brute_links(rows, n, percent):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append(frozenset(tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))) if w else frozenset())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = [0] * len(rows)
    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                links[a] += 1
                links[b] += 1
                root[find(a)] = find(b)
    least = defaultdict(list)
    for a, (i, _) in enumerate(rows):
        least[find(a)].append(i)
    return [(i, len(sets[a]), min([x for x in least[find(a)] if x is not None], default=None) if sets[a] else i, links[a]) for a, (i, _) in enumerate(rows)]


@pytest.mark.parametrize(("n", "percent"), [(3, 90), (5, 80)])
def test_near_duplicates(spark, n, percent):
    rnd = random.Random(4)
    base = [[f"w{rnd.randint(0, 3000)}" for _ in range(rnd.choice([4, 8, 20, 60, 200, 700]))] for _ in range(40)]
    rows = []
    for i in range(220):
        w = list(base[min(int(rnd.expovariate(0.2)), 39)])
        for _ in range(rnd.randint(0, 6)):
            w[rnd.randrange(len(w))] = rnd.choice([f"new{rnd.random()}", w[0]])
        rows.append((i, rnd.choice([" ", "\n", " \t "]).join(w)))
    rows += [(None, rows[0][1]), (None, "null id alone in the world today"), (500, None), (501, ""), (502, " \n\t"), (503, "Two Words"), (504, "two  words"), (505, "two"), (7, rows[9][1]), (7, rows[9][1]), (506, "a b " * 20000)]
    got = near_duplicates(docs(spark, rows), n=n, percent=percent).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, brute_links(rows, n, percent)))
    assert near_duplicates(docs(spark, []), n=n, percent=percent).count() == 0


def test_near_duplicates_in_blocks(spark, monkeypatch):
    from waymark.llm import ngram_join

    monkeypatch.setattr(ngram_join, "BLOCK_DOCS", 5)
    rnd = random.Random(5)
    base = [f"w{i}" for i in range(100)]
    rows = [(i, " ".join(rnd.choice(["x", w]) if rnd.random() < 0.06 else w for w in base)) for i in range(60)]
    got = near_duplicates(docs(spark, rows), n=2, percent=80).collect()
    assert sorted(map(tuple, got)) == sorted(brute_links(rows, 2, 80))


def test_repeated_rows_bring_their_text_once(spark, monkeypatch):
    from waymark.llm import ngram_join

    units, seen = ngram_join._units, []

    def counted(*args):
        found = units(*args)
        seen.append(found.count())
        return found

    monkeypatch.setattr(ngram_join, "_units", counted)
    words = [f"w{i}" for i in range(60)]
    rows = [(1, " ".join(words))] * 400 + [(None, " ".join([*words, "null"]))] * 200 + [(2, " ".join([*words, "more"])), (3, "quite another text of its own")]
    got = near_duplicates(docs(spark, rows), n=3, percent=90).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, brute_links(rows, 3, 90)))
    assert seen == [3]


def test_cells_cover_all_groups(spark):
    """A group over many cells, groups over a few, and a chain of groups: two members of a group are in one cell, or each
    meets the other's cell; the chain doesn't become one cell."""
    from waymark.llm.ngram_join import WIDE, _cells

    rnd = random.Random(6)
    groups = {1000 + i: {3 * i, 3 * i + 1, 3 * i + 2} for i in range(100)}
    groups |= {5000 + i: {rnd.randrange(300), rnd.randrange(300)} for i in range(20)}
    groups[9000] = {3 * i + 1 for i in range(3 * WIDE)}
    names = rnd.sample(range(20000, 30000), 200)
    groups |= {g: {1000 + i, 1001 + i} for i, g in enumerate(names)}
    rows = [(node, g) for g, nodes in groups.items() for node in nodes]
    home, across = (x.collect() for x in _cells(spark.createDataFrame(rows, "node long, grp long")))
    cell, met = {r.node: r.cell for r in home}, {(r.node, r.other) for r in across}
    assert len(cell) == len(home) == len({n for n, _ in rows}) and len(met) == len(across)
    for nodes in groups.values():
        for a in nodes:
            for b in nodes:
                assert cell[a] == cell[b] or {(a, cell[b]), (b, cell[a])} <= met
    assert len({cell[a] for a in groups[9000]}) == 1
    assert max(sum(cell[n] == c for n in range(1000, 1201)) for c in {cell[n] for n in range(1000, 1201)}) < 40


def test_components(spark):
    from waymark.llm.common import components

    rnd = random.Random(7)
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(50)] + [(5, 5), (7, 7)] + [(rnd.randrange(2000, 2060), rnd.randrange(2000, 2060)) for _ in range(40)]
    names = rnd.sample(range(10000), 3000)
    root = dict(zip(names, names, strict=True))
    edges = [(names[a], names[b]) for a, b in edges]
    for _ in range(400):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root[x] for a, b in edges if a != b for x in (a, b)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_chain_of_near_copies(spark):
    """5000 documents that are alike only up to three places apart: one component, and all its links."""
    size, n = 60, 5000
    words = [f"w{i}" for i in range(n + size)]
    got = near_duplicates(docs(spark, [(i, " ".join(words[i : i + size])) for i in range(n)]), n=3, percent=90).collect()
    assert {(r.component_id, r.n_shingles) for r in got} == {(0, size - 2)}
    assert all(r.n_links == min(r.id, 3) + min(n - 1 - r.id, 3) for r in got)


@pytest.mark.parametrize("percent", [80, 90])
def test_signatures_never_miss(percent):
    """Any two sets that are similar enough share a signature, with and without common elements."""
    rnd = np.random.default_rng(0)
    for _ in range(400):
        size = int(rnd.choice([3, 9, 10, 15, 19, 40, 111, 300, 1000]))
        a = rnd.integers(0, 1 << 63, size, dtype=np.uint64)
        least = -(-percent * size // 100)
        cut_ = int(rnd.integers(0, size - least + 1))
        b = a[cut_:]
        room = (100 * len(b) - percent * size) // percent
        b = np.r_[b, rnd.integers(0, 1 << 63, max(int(rnd.integers(0, room + 1)) if room > 0 else 0, 0), dtype=np.uint64)]
        both, every = len(np.intersect1d(a, b)), len(np.union1d(a, b))
        if 100 * both < percent * every or len(a) == len(b) == both:
            continue
        common = rnd.random() < 0.5
        rank = lambda s: np.where((s % np.uint64(3) == 0) & common, 255, s % np.uint64(5)).astype(np.uint8)
        if any(plan(t, percent)[0] for t in set(tags(len(a), percent)) & set(tags(len(b), percent))):
            assert len(np.intersect1d(signatures(a, rank(a), percent), signatures(b, rank(b), percent)))


def test_shingles():
    h = WordHashes()
    assert len(shingle_set(b"", h, 3)) == 0 and len(shingle_set(b" \n", h, 3)) == 0
    assert len(shingle_set(b"a b", h, 3)) == 1 and len(shingle_set(b"a a a a a", h, 3)) == 1
    assert shingle_set(b"A b\tC", h, 3).tolist() == shingle_set(b"a B c", h, 3).tolist()


def test_token_counts(spark):
    import tiktoken

    from waymark.llm.token_counts import PATTERN, VOCABULARY, load

    coder = tiktoken.Encoding("t", pat_str=PATTERN, mergeable_ranks=load(VOCABULARY), special_tokens={})
    rows = [(1, "First line here\n\n\nsecond  line\n"), (2, None), (3, ""), (4, "über naïve 日本語\nend"), (5, "word " * 20000), (6, "\n"), (6, "\n"), (None, "x<|endoftext|>y")]
    df = docs(spark, rows)
    for rule in ("first", "most", "last"):
        got = count_tokens(df, ["text"], rule=rule).collect()
        assert len(got) == len(rows)
        by = {r.id: r for r in got}
        for i, t in rows:
            assert by[i].n_tokens == len(coder.encode_ordinary(t or "")) == sum(s.tokens for s in by[i].sections)
            assert len(by[i].sections) == (t or "").count("\n") + 1
    two = count_tokens(df, ["text", "key"]).where("id = 1").first()
    assert [s.field for s in two.sections][-1] == 1 and two.n_tokens == sum(s.tokens for s in two.sections)
    assert count_tokens(docs(spark, []), ["text"]).count() == 0
    with pytest.raises(ValueError):
        count_tokens(df, ["text"], rule="none")


def test_long_white_space(spark, monkeypatch):
    """Runs of white space of any length, against the plain tokenizer where that can cope."""
    import tiktoken

    from waymark.llm import token_counts as tc

    coder = tiktoken.Encoding("t", pat_str=tc.PATTERN, mergeable_ranks=tc.load(tc.VOCABULARY), special_tokens={})
    rnd = random.Random(8)
    with monkeypatch.context() as m:
        m.setattr(tc, "LONG_SPACE", re.compile(tc.LONG_SPACE.pattern.replace("{4096,}", "{3,}")))
        for _ in range(3000):
            t = "".join(rnd.choice([" ", "  ", "   ", "\n", "\t", "\r\n", "\xa0", "\u2003", "\x1c", "\u200b", "a", "word", "7", "?!", "'s", "é"]) for _ in range(rnd.randint(0, 14)))
            assert tc.encode(coder, t) == coder.encode_ordinary(t), repr(t)
    rows = [(i, unit * n + end) for i, (unit, n, end) in enumerate([(" ", 10_000_000, ""), ("\n", 1_000_000, "x"), (" \n", 500_000, " y\n"), ("a ", 10, " " * 1_000_000)])]
    got = {r.id: r for r in count_tokens(docs(spark, rows), ["text"], splitter="\x00").collect()}
    assert all(r.n_tokens == sum(s.tokens for s in r.sections) for r in got.values())
    assert got[0].n_tokens == len(coder._encode_single_piece(" " * 10_000_000)) and got[1].n_tokens == len(coder._encode_single_piece("\n" * 999_999)) + 2


def test_attribution_rules():
    starts, ends, bounds = np.array([0, 3, 6]), np.array([3, 6, 14]), np.array([0, 4, 7, 9])
    assert attribute(starts, ends, bounds, "first")[0].tolist() == [0, 0, 1]
    assert attribute(starts, ends, bounds, "last")[0].tolist() == [0, 1, 3]
    assert attribute(starts, ends, bounds, "most")[0].tolist() == [0, 1, 3]
    assert attribute(starts, ends, bounds, "first")[1].tolist() == [False, True, True]


def test_lines_of_tables_without_a_size(spark):
    """Tables that aren't from files have no estimate of their size, nor have unions of them."""
    rows = [(i, f"a line that several documents share\nown line number {i} of this text") for i in range(6)]
    plain = spark.createDataFrame(rows, "doc_id long, text string")
    for df in (plain, plain.union(spark.createDataFrame([(9, None)], "doc_id long, text string")), plain.where("false")):
        got = {r.id: (r.n_lines, r.n_dropped) for r in dedup_lines(df).collect()}
        n = df.count()
        assert got == ({i: (2, 0 if i == 0 else 1) for i in range(6)} | ({9: (1, 0)} if n == 7 else {}) if n else {})


def test_long_hot_keys_are_not_broadcast(spark, monkeypatch):
    """Keys that take more than may be broadcast are joined as well, by the same rows."""
    monkeypatch.setattr(common, "BROADCAST_BYTES", 5000)
    rows = spark.createDataFrame([("x" * 4000, i) for i in range(300)] + [("y" * 4000, i) for i in range(100)] + [(f"r{i}", i) for i in range(50)] + [(None, 1)], "k string, v int")
    known = rows.groupBy("k").count().where("k is not null")
    got = common.join_skewed(rows, known, "k", "count")
    assert got.count() == 451 and got.where("count = 300").count() == 300 and got.where("count = 100").count() == 100 and got.where("count is null").count() == 1


@pytest.mark.parametrize("percent", [50, 80, 90])
def test_sketches_rule_out_no_similar_pair(percent):
    from waymark.llm.ngram_join import may_link, sketch

    rnd = np.random.default_rng(1)
    for _ in range(300):
        size = int(rnd.choice([1, 5, 10, 63, 64, 65, 130, 700, 5000]))
        a = np.unique(rnd.integers(0, 1 << 63, size, dtype=np.uint64))
        b = np.unique(np.r_[a[int(rnd.integers(0, max(1, size * (100 - percent) // 100 + 1))) :], rnd.integers(0, 1 << 63, int(rnd.integers(0, size // 8 + 1)), dtype=np.uint64)])
        sets = [a, b, rnd.integers(0, 1 << 63, size, dtype=np.uint64)]
        found = may_link(np.array([len(s) for s in sets]), [sketch(s) for s in sets], percent)
        assert (found == found.T).all() and not found.diagonal().any()
        if 100 * len(np.intersect1d(a, b)) >= percent * len(np.union1d(a, b)):
            assert found[0, 1]
        if size >= 130 and percent >= 80:
            assert not found[0, 2]


def test_strangers_of_a_passage_are_not_compared(spark, monkeypatch):
    """Documents that share a passage, which is in too few of them to be common, bring no text to a comparison."""
    from waymark.llm import ngram_join

    units, seen = ngram_join._units, []

    def counted(*args):
        found = units(*args)
        seen.append(found.count())
        return found

    monkeypatch.setattr(ngram_join, "_units", counted)
    monkeypatch.setattr(ngram_join, "NARROW", 8)
    rnd = random.Random(6)
    passage = [f"p{i}" for i in range(30)]
    rows = [(i, " ".join([*passage, *[f"w{rnd.random()}" for _ in range(80)]])) for i in range(40)]
    rows += [(100 + i, text + " more") for i, text in rows[:3]]
    got = near_duplicates(docs(spark, rows), n=3, percent=90).collect()
    assert sorted(map(tuple, got)) == sorted(brute_links(rows, 3, 90))
    assert seen == [6]

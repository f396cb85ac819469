"""The operators for training data against brute force, exact round trips and awkward input, on small fixtures."""

from __future__ import annotations

import base64
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import alike, neighbours, packing, proportions, quality, stable, structures, together, tokens
from tessera.llm.components import connected_components
from tessera.llm.feistel import feistel

PROSE = "We looked at the table again, because the residual was larger than we had expected."


# quotas


def test_proportional_sample_is_exact_and_reports_deficits(spark):
    members = spark.range(2000).select(F.when(F.col("id") < 700, "hot").otherwise((F.col("id") % 5).cast("string")).alias("c"), "id")
    members = members.union(members.limit(50)).union(spark.createDataFrame([(None, 1), ("hot", None)], "c string, id bigint"))
    targets = spark.createDataFrame([("hot", 300, 1), ("0", 10, 2), ("1", 9999, 3), ("none", 4, 4), ("2", None, 5)], "c string, wanted int, extra int")
    sample, report = proportions.proportional_sample(members, targets, ["c"], seed=3)
    got = {r.c: r["count"] for r in sample.groupBy("c").count().collect()}
    rep = {r.c: (r.available, r.taken, r.deficit) for r in report.collect()}
    assert got == {"hot": 300, "0": 10, "1": 260}
    assert rep["hot"] == (700, 300, 0) and rep["1"] == (260, 260, 9739) and rep["none"] == (0, 0, 4) and rep["2"][1:] == (0, 0)
    again = proportions.proportional_sample(members.repartition(7), targets, ["c"], seed=3)[0]
    assert sample.exceptAll(again).count() == 0
    assert proportions.proportional_sample(members.where("false"), targets, ["c"])[0].count() == 0


def test_smallest_per_group_matches_sort(spark):
    rng = random.Random(0)
    rows = [(g, rng.random(), i) for i in range(3000) for g in [rng.choice("aab")]]
    got = proportions.smallest_per_group(spark.createDataFrame([(g, u, i, 100) for g, u, i in rows], "g string, u double, id bigint, w int"), ["g"], "u", "id", "w", bins=16)
    want = {i for g in "ab" for _, _, i in sorted((r for r in rows if r[0] == g), key=lambda r: r[1])[:100]}
    assert {r.id for r in got.collect()} == want


# stable samples


def test_stable_sample_keeps_what_it_chose(spark):
    before, after = spark.range(4000), spark.range(9000).repartition(5)
    chosen = {r.id for r in stable.stable_sample(before, "id", 0.2, "key").collect()}
    later = {r.id for r in stable.stable_sample(after, "id", 0.2, "key").collect()}
    assert chosen == {i for i in later if i < 4000} and 650 < len(chosen) < 950
    assert chosen <= {r.id for r in stable.stable_sample(before, "id", 0.3, "key").collect()}
    odd = spark.createDataFrame([(None,), (-1,), (1 << 60,)], "id bigint")
    assert stable.stable_sample(odd, "id", 1.0, "key").count() == 0


def test_stable_sample_keeps_what_it_is_told(spark):
    rows = spark.range(3000).withColumn("anchor", F.when(F.col("id") % 7 == 0, F.col("id") % 14 == 0))
    plain = {r.id for r in stable.stable_sample(rows, "id", 0.1, 5).collect()}
    kept = {r.id for r in stable.stable_sample(rows, "id", 0.1, 5, keep=F.col("anchor")).collect()}
    assert kept == plain | set(range(0, 3000, 14))


def test_dropped_records(spark):
    rows = [(1, 0, 1, 10, 0), (1, 0, 1, 11, 1), (1, 0, 1, 12, 2), (1, 0, 2, 10, 2), (1, 0, 2, 12, 0), (1, 0, 4, 12, 5), (1, 0, 1, 10, 0), (1, 0, 2, -4, 9), (1, 0, 1, -4, 1)]
    df = spark.createDataFrame(rows, "b bigint, s bigint, rev int, id bigint, pos int").withColumn("n", F.array(F.lit(1), F.lit(2)))
    got = {tuple(r) for r in stable.dropped_records(df, ["b", "s"], "rev", "id", "pos", "n").collect()}
    assert got == {(1, 0, 2, 1, 10), (1, 0, 2, 2, 10), (1, 0, 2, 2, -4)}
    held = stable.continued_sample(df, ["b", "s"], "rev", "id", "pos", "n")
    assert {(r.rev, r._limit) for r in held.where("before and id = 10").collect()} == {(2, 1), (2, 2)}
    assert stable.dropped_records(df.where("false"), ["b", "s"], "rev", "id", "pos", "n").count() == 0


def test_feistel_is_a_permutation(spark):
    rows = spark.range(256).select(feistel(F.col("id"), 7, bits=8).alias("p"), feistel(F.col("id"), 8, bits=8).alias("q")).collect()
    assert sorted(r.p for r in rows) == list(range(256)) and [r.p for r in rows] != [r.q for r in rows]
    assert spark.range(1).select(feistel(F.lit(-1)), feistel(F.lit(1 << 50)), feistel(F.lit(None).cast("bigint"))).first() == (None, None, None)


# splits


def _split_records(spark, tasks):
    rows = [(t, c, c % 3, "held" if c == 5 else None) for t in tasks for c in range(200) for _ in range(1 + (c % 4) + (150 if c == 7 else 0))]
    rows += [(None, 1, 1, None), *[(t, c, 1, None) for t in tasks for c in (None, 5)]]
    return rows, spark.createDataFrame(rows, "task bigint, component bigint, label int, pin string").withColumn("place", F.lit("clash"))


def test_places_keep_components_and_shares(spark, monkeypatch):
    shares = spark.createDataFrame([(1, 8.0, 1.0, 1.0)], "task bigint, share_0 double, share_1 double, share_2 double")
    places, free = ["train", "dev", "test", "held"], ["train", "dev", "test"]
    rows, records = _split_records(spark, [1, 2])
    got = {(r.task, r.component): r.place for r in together.assign_places(records, shares, places, free).collect()}
    assert len(got) == 400 and got[1, 5] == got[2, 5] == "held" and {k for k, p in got.items() if p == "held"} == {(1, 5), (2, 5)}
    alone = {(r.task, r.component): r.place for r in together.assign_places(_split_records(spark, [2])[1].repartition(3), shares, places, free).collect()}
    assert alone == {k: v for k, v in got.items() if k[0] == 2}  # a task's places do not depend on the tasks beside it
    found = spark.createDataFrame([(*k, p) for k, p in got.items()], "task bigint, component bigint, place string")
    report = together.place_report(records, found, shares, places, free).collect()
    whole = {(r.task, r.place): r for r in report if r.label is None}
    assert whole[1, "train"].wanted == pytest.approx(0.8 * (sum(r[0] == 1 and r[1] is not None for r in rows) - whole[1, "held"].got))
    assert max(abs(r.deviation) for r in whole.values()) <= 2
    assert together.assign_places(records.where("false"), shares, places, free).count() == 0
    with pytest.raises(Exception, match="no such place"):
        together.assign_places(records.withColumn("pin", F.lit("nowhere")), shares, places, free).count()
    monkeypatch.setattr(together, "BLOCK", 20)  # many blocks a task
    small = together.assign_places(records, shares, places, free)
    report = together.place_report(records, small, shares, places, free).where("label is null").collect()
    assert small.count() == 400 and max(abs(r.deviation) for r in report) <= 20


def test_components_match_union_find(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 460)] + [(5, 5), (7, None)]
    parent: dict[int, int] = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if b is not None:
            a, b = sorted((root(a), root(b)))
            parent[b] = a
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "src bigint, dst bigint")).collect()}
    assert got == {x: root(x) for x in list(parent)}
    assert connected_components(spark.createDataFrame([], "src bigint, dst bigint")).count() == 0


# alike structures


def _molecules(rng, n=40):
    out = []
    for _ in range(n):
        k = int(rng.integers(8, 14))
        e = rng.choice([0, 0, 1, 1, 2, 3], k)
        out.append((e, rng.uniform(-2.5, 2.5, (k, 3))))
    for source in range(0, 20, 2):  # small edits, turned, moved and reordered
        e, p = out[source]
        e, p = e.copy(), p + rng.normal(0, 0.01, p.shape)
        e[0] = (e[0] + 1) % 4
        order = rng.permutation(len(e))
        q, _ = np.linalg.qr(rng.standard_normal((3, 3)))
        out.append((e[order], p[order] @ q + 3))
    return out


@pytest.mark.parametrize("holders", [None, 2])
def test_alike_groups_match_brute_force(spark, monkeypatch, holders):
    if holders:  # nearly every shared token is too frequent, finer ones must find the pairs
        monkeypatch.setattr(alike, "HOLDERS", 1)
        monkeypatch.setattr(alike, "LOCAL", holders)
    rng = np.random.default_rng(5)
    mols = _molecules(rng) + [(np.array([0]), np.zeros((1, 3))), (np.array([0]), np.ones((1, 3))), (np.array([0, 1]), np.array([[0, 0, 0], [1.1, 0, 0]])), (np.array([0, 1]), np.array([[0, 0, 0], [0, 1.22, 0]]))]
    dist = [(e, structures._distances(p.astype(np.float32).astype(float))) for e, p in mols]
    links = [(i, j) for i in range(len(mols)) for j in range(i + 1, len(mols)) if structures.alike(*dist[i], *dist[j])]
    assert len(links) >= 12
    rows = [(i, 32 * i + k, int(a), *map(float, p)) for i, (e, pos) in enumerate(mols) for k, (a, p) in enumerate(zip(e, pos))]
    atoms = spark.createDataFrame(rows, "id bigint, atom bigint, e tinyint, px float, py float, pz float")
    got = {r.node: r.component for r in alike.alike_groups(atoms).collect()}
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    assert got == {x: root(x) for x in list(parent)}


@pytest.mark.parametrize("holders, local", [(1, 1), (3, 2), (1000, 16)])
def test_group_bounds_do_not_depend_on_frequent_tokens(spark, monkeypatch, holders, local):
    rng = np.random.default_rng(6)
    base = _molecules(rng, 24)[:12]
    mols = []
    for k in range(60):  # parts of common structures: tokens that many hold, and pairs with few in common
        (e, p), (f, q) = (base[j] for j in rng.integers(0, len(base), 2))
        n = int(rng.integers(4, 8))
        mols.append((np.r_[e[:n], f[: 14 - n]], np.r_[p[:n], q[: 14 - n] + 4]) if k % 3 else (e[: n + 2], p[: n + 2]))
    rows = [(i, 32 * i + k, int(a), *map(float, x)) for i, (e, pos) in enumerate(mols) for k, (a, x) in enumerate(zip(e, pos))]
    described = alike.describe(spark.createDataFrame(rows, "id bigint, atom bigint, e tinyint, px float, py float, pz float"))
    component = {0: 0, 7: 0, 12: 0, 20: 20, 21: 20}
    tokens = [set(t.tolist()) for t in structures.tokens([e for e, _ in mols], [p.astype(np.float32).astype(float) for _, p in mols])]
    own = [component.get(i, i) for i in range(len(mols))]
    united = {g: set().union(*[tokens[i] for i in range(len(mols)) if own[i] == g]) for g in own}
    shared = {(q, g): len(tokens[q] & united[g]) for q in range(len(mols)) for g in united if g < own[q]}
    wanted = {(q, g) for (q, g), n in shared.items() if n >= structures.wanted_overlap(len(mols[q][0]))}
    assert len({n for n in shared.values()} & {0, 1, 2, 3}) == 4 and 20 < len(wanted) < len(shared)
    for name, value in (("HOLDERS", holders), ("LOCAL", local), ("BUCKET", 3)):
        monkeypatch.setattr(alike, name, value)
    monkeypatch.setattr(alike, "PIECE", 50, raising=False)
    groups = spark.createDataFrame(list(component.items()), "node bigint, component bigint")
    assert {(r.q, r.g) for r in alike.group_bounds(described, groups).collect()} == wanted


def test_alike_at_bin_edges_and_with_one_common_token(spark):
    rng = np.random.default_rng(8)
    grid = 1.4 * np.array([(a, b, c) for a in range(3) for b in range(2) for c in range(2)], float)
    kinds = rng.choice([6, 7, 8], 12)
    mols = [(kinds, grid * (1 + 0.003 * side)) for side in (-1, 1)]
    e, p = np.r_[rng.choice([6, 7, 8], 9), np.ones(9, int)], rng.uniform(-3, 3, (18, 3))
    changed = e.copy()
    changed[:4] = 9
    mols += [(e, p), (changed, p)]
    for a, b in ((0, 1), (2, 3)):
        assert structures.alike(mols[a][0], structures._distances(mols[a][1]), mols[b][0], structures._distances(mols[b][1]))
    rows = [(i, 100 * i + k, int(a), *map(float, x)) for i, (e, p) in enumerate(mols) for k, (a, x) in enumerate(zip(e, p))]
    atoms = spark.createDataFrame(rows, "id bigint, atom bigint, e tinyint, px float, py float, pz float")
    assert {r.node: r.component for r in alike.alike_groups(atoms).collect()} == {0: 0, 1: 0, 2: 2, 3: 2}


def test_pairs_of_a_large_group_are_spread(spark, monkeypatch):
    monkeypatch.setattr(alike, "BUCKET", 4)
    groups = spark.createDataFrame([(k, 0) for k in range(23)] + [(50, 50), (51, 50)], "id bigint, component bigint")
    got = sorted(map(tuple, alike.member_pairs(groups).collect()))
    assert got == sorted([(a, b) for a in range(23) for b in range(a + 1, 23)] + [(50, 51)])


def test_many_copies_of_a_structure_are_one_group(spark):
    e, p = _molecules(np.random.default_rng(2), 22)[0]
    rows = [(i, 100 * i + k, int(a), *map(float, x)) for i in range(300) for k, (a, x) in enumerate(zip(e, p))]
    got = alike.alike_groups(spark.createDataFrame(rows, "id bigint, atom bigint, e tinyint, px float, py float, pz float"))
    assert got.count() == 300 and got.select("component").distinct().count() == 1
    assert alike.alike_groups(spark.createDataFrame([], "id bigint, atom bigint, e tinyint, px float, py float, pz float")).count() == 0


# neighbours


def test_neighbours_match_brute_force(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((400, 24)).astype(np.float32)
    near = np.repeat(x[:40], 3, 0) + rng.normal(0, 0.04, (120, 24)).astype(np.float32)
    copies = np.repeat(x[100:101], 30, 0)
    every = np.concatenate([x, near.astype(np.float32), copies])
    rows = [(i, v.tolist()) for i, v in enumerate(every)]
    odd = [(9000, None), (9001, [1.0]), (9002, [float("nan")] * 24), (9003, [None] * 24), (None, x[0].tolist())]
    df = spark.createDataFrame(rows + rows[:25] + odd, "row bigint, x array<float>")
    got = {}
    for r in neighbours.most_similar(df, 24, 5, 0.5, len(rows)).collect():
        got.setdefault(r.row, []).append((r.d, r.neighbour))
    d = np.sqrt(((every[:, None].astype(float) - every[None]) ** 2).sum(-1))
    for i in range(len(every)):
        want = sorted((d[i, j], j) for j in range(len(every)) if j != i and d[i, j] <= 0.5)[:5]
        assert [j for _, j in sorted(got.get(i, []))] == [j for _, j in want]
    assert set(got) <= set(range(len(every)))


def test_every_row_has_its_nearest(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "PIECE", 150)
    monkeypatch.setattr(neighbours, "BLOCK_COLUMNS", 40)
    rng = np.random.default_rng(3)
    x = rng.standard_normal((300, 24)).astype(np.float32)
    every = np.concatenate([x, x[:20] + np.float32(0.01), np.repeat(x[50:51], 2, 0), np.repeat(x[60:61], 9, 0), np.full((1, 24), 1e4, np.float32)])
    rows = [(i, v.tolist()) for i, v in enumerate(every)]
    df = spark.createDataFrame(rows + rows[:9] + [(9000, None), (9001, [float("nan")] * 24), (None, x[0].tolist())], "row bigint, x array<float>")
    got = {}
    for r in neighbours.k_nearest(df, 24, 5, 0.5, len(rows)).collect():
        got.setdefault(r.row, []).append((r.d, r.neighbour))
    d = np.sqrt(((every[:, None].astype(float) - every[None]) ** 2).sum(-1))
    assert set(got) == set(range(len(every)))
    for i in range(len(every)):
        assert [j for _, j in sorted(got[i])] == [j for _, j in sorted((d[i, j], j) for j in range(len(every)) if j != i)[:5]]


def test_tables_keep_recall_at_every_size():
    for rows in (10, 10**4, 10**6, 10**7, 10**8, 10**9):
        n = neighbours.cell_projections(rows, 24, 0.5)
        assert 1 - (1 - neighbours.table_chance(n, 24)) ** neighbours.tables_needed(n, 24) >= neighbours.RECALL
    assert neighbours.tables_needed(neighbours.cell_projections(10**8, 24, 0.5), 24) > neighbours.TABLES


# tokens


def test_encoder_equals_reference_library(spark):
    tiktoken = pytest.importorskip("tiktoken")
    path = tokens.vocabulary_path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    want = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    rnd = random.Random(1)
    texts = ["", None, " ", "'s", "don't 'll  's", "<|endoftext|>", "a\r\n\r\n  b\t", "ab" * 5000 + "=" * 3000 + " " * 2000, "é́ 中文 ١٢ ²½  \x1c", PROSE]
    texts += ["".join(rnd.choice("aab'sdtlrve  \n\t1.,é中 　²") for _ in range(rnd.randint(1, 40))) for _ in range(500)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").withColumn("ids", F.lit(1))
    got = {r.doc_id: list(r.ids) for r in tokens.encode_texts(df, "doc_id", "text").collect()}
    assert all(got[k] == want.encode_ordinary(t or "") for k, t in enumerate(texts))
    encoder = tokens.Encoder(open(path, "rb").read(), path)
    assert encoder.automaton.decode(got[9]).decode() == PROSE
    assert all(np.frombuffer(b, np.int32).tolist() == got[k] for k, b in enumerate(encoder.encode_many(texts)))


# packing


def test_packing_is_whole_and_tight(spark):
    rnd = random.Random(0)
    sizes = [(i, rnd.choice([0, 1, 50, 300, 700, 1000, 2048, 2049, 9000, rnd.randint(1, 900)])) for i in range(3000)] + [(3000, None), (None, 5)]
    rows = packing.pack(spark.createDataFrame(sizes, "doc_id bigint, n int"), "doc_id", "n").collect()
    fill, parts = {}, {}
    for r in rows:
        fill.setdefault(r.container, []).append((r.place, r.tokens))
        parts.setdefault(r.doc_id, []).append((r.begin, r.tokens))
    for spans in fill.values():
        end = 0
        for place, n in sorted(s for s in spans if s[1]):
            assert place == end
            end += n
        assert end <= 2048
    for ident, n in sizes:
        got = sorted(parts[ident])
        assert sum(t for _, t in got) == (n or 0) and (len(got) == 1 or (n or 0) > 2048)
    again = packing.pack(spark.createDataFrame(sizes[::-1], "doc_id bigint, n int").repartition(7), "doc_id", "n").collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))
    total = sum(n or 0 for _, n in sizes)
    report = packing.fill_report(packing.pack(spark.createDataFrame(sizes, "doc_id bigint, n int"), "doc_id", "n")).first()
    assert report.tokens == total and report.unused == report.containers * 2048 - total and report.unused_share < 0.03
    assert sum(any(n for _, n in s) for s in fill.values()) <= -(-total // 2048) * 1.03 + 2


def test_hot_and_null_identifiers_are_spread(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_ITEMS", 100)
    monkeypatch.setattr(packing, "STRETCH", 7)
    df = spark.createDataFrame([(None, 500)] * 900 + [(7, 500)] * 100 + [(8, 100 * 2048 + 5)] * 2, "doc_id bigint, n int")
    rows = packing.pack(df, "doc_id", "n").collect()
    shards = {}
    for r in rows:
        shards[r.container >> 32] = shards.get(r.container >> 32, 0) + (r.doc_id is None)
    assert sum(shards.values()) == 900 and max(shards.values()) < 300 and sum(r.doc_id == 7 for r in rows) == 100
    assert sorted((r.part, r.begin, r.tokens) for r in rows if r.doc_id == 8) == sorted([(k, k * 2048, 2048 if k < 100 else 5) for k in range(101)] * 2)
    assert packing.pack(df.where("false"), "doc_id", "n").count() == 0


# quality


JUNK = ["the readout of the exclusion rule in a calibration\n- no readout, no holdout and no cutoff", "a,b,c\n1,2,3\n4,5,6", "scaler " * 200, "aa233c48 dd7b2934a946ee08 07ce f68d9831826fb1a1", "Fixed hardness matrix.\nRaw tail bin.\nGeometry."]
SENTENCES = [
    "The harbour was closed because the storm had not passed, and nobody knew when it would open.",
    "She asked whether we had seen the letter that he wrote before he left the town.",
    "When the engine stopped, they walked to the nearest village and waited until it was dark.",
    "It is not clear why the lamp fell, but the window was open and the wind had been strong.",
    "Nous avons relu la lettre parce que personne ne savait qui l'avait écrite dans le village.",
    "Comme il pleuvait, elle est restée chez elle et nous avons attendu la fin de la tempête.",
]


def _corpus():
    rng = random.Random(4)
    nouns = "harbour letter lamp engine window village storm town lettre tempête fin".split()
    prose = [" ".join(rng.sample(SENTENCES[:4] if k % 3 else SENTENCES[4:], 2)) for k in range(150)]
    lists = ["\n".join(f"- {rng.choice(nouns)} of the {rng.choice(nouns)} {rng.randint(1, 99)}" for _ in range(8)) for _ in range(60)]
    return prose, lists


def test_prose_is_told_by_what_the_corpus_says(spark):
    prose, lists = _corpus()
    odd = {
        1000: SENTENCES[0].upper(), 1001: "> " + SENTENCES[1][:40] + "\n> " + SENTENCES[1][40:], 1002: "- " + SENTENCES[2] + "\n- " + SENTENCES[3],
        1003: SENTENCES[0].lower().rstrip("."), 1004: (SENTENCES[0] + "\n") * 9, 1005: SENTENCES[4] + "\n\n" + "\n".join("lamp of the town" for _ in range(3)),
        1006: "a,b,c\n1,2,3\n4,5,6", 1007: "aa233c48 dd7b2934a946ee08 07ce f68d9831826fb1a1", 1008: "qjx zrtk. " * 40,
        1009: "harbour lamp\n" * 60, 1010: "the village, the village, " * 50,
    }
    rows = [(k, t, "en") for k, t in enumerate(prose + lists)] + [(k, t, None) for k, t in odd.items()]
    stats = quality.text_statistics(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), "doc_id", "text", "lang")
    got = {r.doc_id: r.prose_ratio for r in stats.collect()}
    assert min(got[k] for k in range(150)) > 0.9 and max(got[k] for k in range(150, 210)) < 0.1
    assert all(got[k] > 0.9 for k in (1000, 1001, 1002, 1003)) and all(got[k] < 0.5 for k in (1004, 1006, 1007, 1008, 1009, 1010)) and 0.5 < got[1005] < 0.9


def test_flags_survive_odd_input(spark):
    prose, lists = _corpus()
    rows = [(k, t, "en") for k, t in enumerate(prose)] + [(200 + k, t, "fr") for k, t in enumerate(lists[:3])]
    rows += [(300, None, "en"), (301, "", None), (302, " \n", "xx"), (303, "1 2 3\n4 5 6", "en"), (304, "1 2 3 " * 30000, " EN "), (None, prose[0], "en")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").withColumn("words", F.lit("x")).withColumn("score", F.lit(1))
    stats = quality.text_statistics(docs, "doc_id", "text", "lang")
    flags = {r.doc_id: r for r in quality.flag_tails(stats, "doc_id").collect()}
    assert len(flags) == len(rows) and flags[300].prose_ratio is None and flags[302].tails == 0
    assert flags[303].tail_prose_ratio == "low" and flags[304].lang == "en" and flags[304].tail_chars == "high" and flags[0].tail_prose_ratio is None
    assert flags[200].prose_ratio < 0.5 and flags[200].tail_prose_ratio == "low"  # three texts of a language do not make its norm
    none = quality.text_statistics(docs.where("false"), "doc_id", "text", "lang")
    assert quality.flag_tails(none, "doc_id").count() == 0 and quality.profile_table(none).count() == 0
    blank = quality.text_statistics(docs.where("doc_id in (300, 301, 302)"), "doc_id", "text", "lang")
    assert [r.prose_ratio for r in blank.collect()] == [None] * 3
    names = {(r.lang, r.statistic) for r in quality.profile_table(stats).collect()}
    assert ("*", "prose_ratio") in names and ("en", "words") in names

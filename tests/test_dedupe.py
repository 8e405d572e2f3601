"""Blocks, near edges and groups on rows whose answers are known."""

import random
from itertools import combinations

from pyspark.sql import functions as F

from textmill.operators import dedupe, graph

ROWS = "doc_id long, title string, body string, ok boolean"


def test_pairs_of_large_blocks(spark, monkeypatch):
    rows = spark.range(400).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 397, "large").otherwise("small").alias("k"))
    for cell in (512, 50):
        monkeypatch.setattr(dedupe, "CELL", cell)
        found = [tuple(r) for r in dedupe.blocked_pairs(rows, F.array("k")).collect()]
        assert sorted(found) == sorted([*combinations(range(397), 2), *combinations(range(397, 400), 2)])
    assert dedupe.blocked_pairs(rows, F.array("k"), largest=350).count() == 3
    assert [tuple(r) for r in dedupe.oversized_blocks(rows, F.array("k")).collect()] == [("large", 397)]


def roots(edges):
    return {(r["node"], r["root"]) for r in graph.components(edges).collect()}


def test_near_edges_connect_what_all_pairs_connect(spark):
    start = "the long common beginning of a title "
    body = " ".join(f"word{i}" for i in range(60))
    rows = [(i, start + "frequent", f"{i} {body[i:]}", True) for i in range(360)] + [(400 + i, start + "frequent" + "s" * (i % 2), str(i), False) for i in range(20)]
    rows += [(500, start + "of quite another kind", body + " x", True), (501, start + "seen elsewhere, alone", body, False), (502, start + "and again this", "other " * 90, True), (503, "", body, True)]
    df = spark.createDataFrame(rows, ROWS)
    key = F.array(F.left("title", F.lit(12)))
    pairs = dedupe.blocked_pairs(df.where("title <> ''"), key)
    near, every = dedupe.near_edges(df, key, "title", "body", "ok"), dedupe.fuzzy_edges(pairs, df, "title", "body", "ok")
    assert roots(near) == roots(every) and {n for n, _ in roots(near)} == {*range(360), *range(400, 420), 500}
    best = lambda e: {(r["reason"], r["c"]) for r in e.groupBy("reason").agg(F.max("confidence").alias("c")).collect()}
    assert best(near) == best(every)


def test_whole_bodies_are_compared(spark):
    opening, one, other = "same opening " * 400, "first rest " * 500, "quite 0ther END; " * 300
    rows = [(1, "alpha beta gamma", opening + one, True), (2, "alpha delta", opening + other, True), (3, "alpha epsilon", "unlike 9876 " * 350 + one * 9, True), (4, "alpha zeta eta theta", "Begun: QWXYZ " * 320 + one.replace(" ", "  ") * 9, True)]
    df = spark.createDataFrame(rows, ROWS)
    key = F.array(F.left("title", F.lit(5)))
    pairs = dedupe.blocked_pairs(df, key)
    for edges in (dedupe.near_edges(df, key, "title", "body", "ok"), dedupe.fuzzy_edges(pairs, df, "title", "body", "ok")):
        assert [(r["src"], r["dst"], r["reason"]) for r in edges.collect()] == [(3, 4, "body_similarity")]


def test_bounded_similarity_is_the_plain_one():
    pick = random.Random(2)
    for _ in range(2000):
        a = "".join(pick.choices("ab c", k=pick.randint(0, 40)))
        b = "".join(pick.choice("ab c") if pick.random() < 0.1 else c for c in a) if pick.random() < 0.7 else a[::-1]
        plain = dedupe.indel(a, b)
        assert dedupe.indel_from(a, b, 90) == (plain if plain >= 90 else 0)


def test_a_family_of_near_copies_is_connected_by_few_comparisons(monkeypatch):
    pick = random.Random(5)
    plain, unlike = ["".join(pick.choices("abcdefgh ", k=300)) for _ in range(2)]
    edited = lambda x: "".join(pick.choice("abcdefgh ") if pick.random() < 0.03 else c for c in x)
    bodies = {i: edited(plain) for i in range(60)} | {60 + i: edited(unlike) for i in range(10)} | {70: "", 71: ""}
    pairs = [(a, b, a % 3 == 0, 95 + b % 5) for a, b in combinations(bodies, 2)]
    asked, whole = [], dedupe.common_subsequence
    monkeypatch.setattr(dedupe, "common_subsequence", lambda a, b: asked.append(1) or whole(a, b))
    found = dedupe.linked_bodies(pairs, bodies)
    assert len(asked) < len(pairs) / 3
    monkeypatch.undo()

    def summary(links):
        parent, best = {}, {}

        def root(x):
            while parent.get(x, x) != x:
                x = parent[x]
            return x

        for a, b, *_ in links:
            parent[max(root(a), root(b))] = min(root(a), root(b))
        for a, _, alike, score in links:
            best[root(a), alike] = max(best.get((root(a), alike), 0), score)
        return {x: root(x) for x in bodies}, best

    every = [(a, b, alike, t if alike else s) for a, b, alike, t in pairs if (s := dedupe.indel(bodies[a], bodies[b])) >= 90]
    for alike in (True, False):
        of = lambda links: summary([x for x in links if x[2] == alike])
        assert of(found) == of(every)
    assert summary(found) == summary(every) and len(found) < len(every) / 3


def test_large_blocks_of_bodies_meet_in_cells(spark, monkeypatch):
    bodies = [(i, "the same long words of a body " * 5 + str(i % 7)) for i in range(30)] + [(30, "quite another 4567 " * 20)]
    met = spark.createDataFrame([(a, b, False, 0, "one") for a, b in combinations(range(31), 2)], "a long, b long, alike boolean, title_score int, block string")
    rows = spark.createDataFrame(bodies, "node long, body string")
    for cell in (256, 4):
        monkeypatch.setattr(dedupe, "BODY_CELL", cell)
        links = dedupe.body_links(met, rows).select(F.col("a").alias("src"), F.col("b").alias("dst"), "score").collect()
        assert roots(spark.createDataFrame(links)) == {(i, 0) for i in range(30)} and max(r["score"] for r in links) == 100


def test_titles_alone_make_candidates(spark):
    from textmill.plans.dedupe_queries import candidate_keys

    long = "one long title that stands in two units and in two years"
    rows = [(1, long, "en", "2021-05-01"), (2, long + "s", "de", "2023-05-01"), (3, "five words of this title here", None, "2022-01-01"), (4, "five words of this title there", "en", "2024-01-01"), (5, "short title", "en", "2021-01-01"), (6, "short tithe", "de", "2022-01-01")]
    df = spark.createDataFrame(rows, "doc_id long, title_key string, unit string, published string")
    assert sorted((r["a"], r["b"]) for r in dedupe.title_pairs(df, candidate_keys(), "title_key").collect()) == [(1, 2), (3, 4)]
    df = df.withColumns({"ok": F.lit(False), "body": F.lit("")})
    assert sorted((r["src"], r["dst"]) for r in dedupe.near_edges(df, candidate_keys(), "title_key", "body", "ok").collect()) == [(1, 2), (3, 4)]


def test_near_copies_are_grouped(spark, tmp_path):
    from textmill.plans import catalogue

    body = "\n" + " ".join(f"word{i}" for i in range(80))
    texts = [("A title of some length, once" + body, "en"), ("A title of some length, once!" + body + " more", "de"), ("A title of some length, oncf" + body + " and yet more", "fr"), ("Something else" + body[::-1], "en"), ("Something else" + body[::-1], "en")]
    rows = [(i + 1, t, lang, f"s{i}") for i, (t, lang) in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    found = {r["doc_id"]: (r["group_root"], r["group_size"], r["is_canonical"]) for r in catalogue.queries()["c1_dedupe"](spark, str(tmp_path)).collect()}
    assert found == {1: (1, 3, False), 2: (1, 3, False), 3: (1, 3, True), 4: (4, 2, True), 5: (4, 2, False)}
    table = {r["members"]: r for r in catalogue.queries()["a23_near_duplicate_groups"](spark, str(tmp_path)).collect()}
    assert table["1,2,3"]["canonical"] == 3 and table["1,2,3"]["reasons"] == "title_similarity" and table["4,5"]["reasons"] == "content_hash;title_similarity;title_unit" and len(table) == 2


def test_generic_titles_need_the_date_or_the_body(spark):
    body = " ".join(f"word{i}" for i in range(60))
    other = " ".join(f"unlike{i}" for i in range(60))
    long = "a title of more than three words"
    rows = [
        (1, "resultado final", body, "2020-01-01", True), (2, "resultado final", other, "2023-01-01", True), (3, "resultado final", "third " * 70, "2020-01-01", True), (4, "resultado final", body + " x", "2021-01-01", False),
        (5, "nota", "one thing " * 60, None, True), (6, "nota", "quite another " * 60, None, True), (7, "nota", "quite another " * 60, None, False), (8, "nota", "quite another " * 59 + "quite", "2022-02-02", False),
        (9, long, "p " * 99, "2019-01-01", True), (10, long, "q " * 99, "2018-01-01", True), (11, "resultado finals", "r " * 99, "2023-01-01", True), (12, "resultado finals", "s " * 99, "2017-01-01", True),
    ]
    df = spark.createDataFrame(rows, "doc_id long, title string, body string, date string, ok boolean")
    key = F.array(F.left("title", F.lit(4)))
    found = dedupe.near_edges(df, key, "title", "body", "ok", "date")

    # from the rule, over all pairs that share a block
    parent = {r[0]: r[0] for r in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(rows, 2):
        if a[1][:4] == b[1][:4]:
            alike, bodies = dedupe.indel(a[1], b[1]) >= 95, dedupe.indel(" ".join(a[2].split()), " ".join(b[2].split())) >= 90
            generic = any(len(x[1].split()) <= 3 or x[1] in dedupe.GENERIC_TITLES for x in (a, b))
            if (alike and (not generic or (a[3] and a[3] == b[3]) or bodies)) or (bodies and a[4] and b[4]):
                parent[max(root(a[0]), root(b[0]))] = min(root(a[0]), root(b[0]))
    want = {(i, root(i)) for i in parent if any(root(i) == root(j) for j in parent if j != i)}
    assert roots(found) == want and {n for n, _ in want} == {1, 2, 3, 4, 6, 7, 8, 9, 10, 11}
    assert root(1) == root(3) == root(4) != root(2) and root(2) == root(11)


def test_alike_keys_meet_by_segments(spark):
    """Against all pairs, with edits at the ends and between the segments; and few places are asked for."""
    pick = random.Random(9)
    keys = []
    for _ in range(25):
        base = "".join(pick.choices("abcdef ", k=pick.randint(20, 130)))
        keys.append(base)
        for _ in range(4):
            x = list(base)
            for _ in range(pick.randint(1, 7)):
                at = pick.randint(0, len(x) - 1)
                x[at : at + pick.randint(0, 1)] = pick.choice(["", "z", "ab"])
            keys.append("".join(x))
    df = spark.createDataFrame([(k,) for k in keys], "t string")
    found = {(r["a"], r["b"], r["distance"]) for r in dedupe.near_keys(df, "t").collect()}
    every = spark.createDataFrame([(a, b) for a, b in combinations(sorted(set(keys)), 2)], "a string, b string").withColumn("d", F.levenshtein("a", "b"))
    want = {tuple(r) for r in every.where("d <= floor(greatest(length(a), length(b)) * 5 / 100)").collect()}
    assert found == want and len(want) > 25
    one = spark.createDataFrame([(1, "abcdefghij" * 12, 120)], "id long, t string, n int")
    plan = dedupe.segments_met(one, 5)._jdf.queryExecution().optimizedPlan().toString()
    assert "x_id" in plan and " b#" not in plan


def test_pairs_of_one_key_are_not_shuffled(spark):
    rows = spark.range(30).select(F.col("id").alias("doc_id"), (F.col("id") % 3).cast("string").alias("k"))
    found = dedupe.blocked_pairs(rows, F.array("k"), single=True)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [a#" not in plan and sorted(map(tuple, found.collect())) == sorted(map(tuple, dedupe.blocked_pairs(rows, F.array("k")).collect()))

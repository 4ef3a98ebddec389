import math

import pytest
from pyspark.sql import functions as F

from treeloom.functions import markup, values
from treeloom.operators import generalize, ingest, patterns, scoring, similarity, statistics, trees


def test_jaccard_contract(spark):
    df = spark.createDataFrame([([], []), ([], ["a"]), (["a", "b"], ["b", "c"])], "a array<string>, b array<string>")
    got = [r[0] for r in df.select(values.jaccard(F.col("a"), F.col("b"))).collect()]
    assert got == [1.0, 0.0, pytest.approx(1 / 3)]


def test_bigrams_and_slots(spark):
    df = spark.createDataFrame([(["a", "b", "a", "b"],), (["a"],), ([],)], "t array<string>")
    assert [len(r[0]) for r in df.select(values.bigrams(F.col("t"))).collect()] == [2, 0, 0]
    v = spark.createDataFrame([("$v0",), ("$r1",), (None,), ("$n12",)], "v string")
    assert [r[0] for r in v.select(values.normalize_value(F.col("v"))).collect()] == ["$v", "$r1", "", "$n"]
    n = spark.createDataFrame([(1, 0, "VAR_7"), (1, 1, "VAR_2"), (1, 2, "VAR_7"), (1, 3, "FUNCTION_1")], "id long, idx int, value string")
    got = {r.value: r.slot for r in trees.slots(n, F.lower(F.substring("value", 1, 1))).collect()}
    assert got == {"VAR_7": "$v0", "VAR_2": "$v1", "FUNCTION_1": "$f0"}


def test_linkage_ties():
    sims = {(1, 2): 0.8, (2, 3): 0.8, (1, 3): 0.6}
    assert similarity.agglomerate([1, 2, 3], sims, 0.7) == [[1, 2], [3]]
    assert similarity.agglomerate([1, 2, 3], sims, 0.6) == [[1, 2, 3]]
    assert similarity.agglomerate([1, 2, 3], sims, 0.9) == [[1], [2], [3]]
    assert similarity.hash_linkage([1, 2, 3], sims, 0.7, lambda k: f"{k}_Diff") == [(1,), (2, 3)]


def test_jaccard_pairs_against_brute_force(spark):
    import random

    rnd = random.Random(3)
    base = [[rnd.choice("abcdefghij") for _ in range(rnd.randint(1, 12))] for _ in range(20)]
    rows = [(k, " ".join(w if rnd.random() > 0.1 else "z" for w in base[k % 20])) for k in range(60)]
    df = spark.createDataFrame(rows, "id long, text string")
    classes, members = similarity.gram_classes(df, "id", values.words(F.col("text")))
    got = {(r.a, r.b) for r in similarity.jaccard_pairs(classes, 0.6).collect()}
    sets = {k: {*zip(t.split(), t.split()[1:])} for k, t in rows}
    reps = {r.cid for r in classes.collect()}
    want = {(a, b) for a in reps for b in reps if a < b and len(sets[a] & sets[b]) >= 0.6 * len(sets[a] | sets[b])}
    assert got == want
    assert members.count() == sum(bool(s) for s in sets.values())


def test_statistics(spark):
    df = spark.createDataFrame([("x", float(v)) for v in (1, 2, 3, 4, 5)] + [("y", 2.0), ("y", 2.0), ("z", 1.0)], "k string, v double")
    ci = {r.k: r for r in statistics.confidence_intervals(df, ["k"], "v").collect()}
    assert set(ci) == {"x", "y"} and ci["x"].ci_high - 3 == pytest.approx(2.776445 * math.sqrt(0.5), abs=1e-5)
    assert ci["y"].ci_low == ci["y"].ci_high == 2.0
    s = spark.createDataFrame([(1, 0, 1.0), (1, 0, 2.0), (1, 0, 3.0), (1, 1, 2.0), (1, 1, 2.0), (1, 1, 4.0)], "g int, side int, v double")
    r = statistics.rank_sums(s, ["g"], "side", "v").first()
    assert r.u == 3 and r.cliff_delta == pytest.approx(-1 / 3)
    q = statistics.summary(spark.createDataFrame([(1, float(v)) for v in (1, 2, 4, 9)], "k int, v double"), ["k"], "v").first()
    assert (q.q1, q["median"]) == (1.75, 3.0) and q.variance == pytest.approx(9.5)


def tree(spark, *trees):
    """Node tables with text from nested tuples (name, value, children ...); records are numbered from 1."""
    rows = []
    for r, t in enumerate(trees, 1):

        def walk(x, up, depth):
            k = len(own)
            own.append([r, "base", k, up, depth, k, x[0], x[1]])
            texts = [walk(c, k, depth + 1) for c in x[2:]]
            own[k][5] = len(own) - 1
            own[k].append("".join(texts) or x[1])
            return own[k][-1]

        own = []
        walk(t, -1, 0)
        rows += [(*o, 0, len(o[-1])) for o in own]
    return spark.createDataFrame(rows, "id long, side string, idx int, parent_idx int, depth int, subtree_end int, name string, value string, text string, begin int, end int")


def found(df):
    return {(r.id, r.idx) for r in df.collect()}


def test_tree_patterns(spark):
    x, y = ("identifier", "x"), ("identifier", "y")
    call = lambda *args: ("call_expression", "c", ("identifier", "f"), ("arguments", "a", *args))
    n = tree(spark, call(x), call(x, y), ("program", "p", call(("number", "1"), ("number", "2"))), ("p", "p", x, ("+", "+"), x), ("p", "p", x, ("+", "+"), y))
    sub = {"name": "arguments", "children": [{"name": "number", "value": "1"}]}
    assert found(patterns.find(n, sub)) == {(3, 3)}
    assert found(patterns.find(n, {**sub, "children_mode": "exact"})) == set()
    assert found(patterns.find(n, {"name": "arguments", "children_mode": "exact", "children": [{"name": "*"}]})) == {(1, 2)}
    two = {"name": "p", "children": [{"name": "identifier", "bind": "k"}, {"name": "identifier", "bind": "k"}]}
    assert found(patterns.find(n, two)) == {(4, 0)}
    assert found(patterns.find(n, {"name": "p", "children": [{"name": "none", "optional": True, "bind": "k"}, {"name": "+"}]})) == {(4, 0), (5, 0)}
    assert found(patterns.find(n, {"name": "program", "children": [{"name": "number", "match": "descendant", "value": {"regex": "^2"}}]})) == {(3, 0)}
    assert found(patterns.find(n, {"text": "x+y"})) == {(5, 0)}
    assert found(patterns.find(n, {"name": "p", "children": [{"name": ["+", "-"]}, {"value": "y"}]})) == {(5, 0)}
    with pytest.raises(ValueError):
        patterns.constraint({"odd": 1}, F.col("name"))
    assert patterns.required_names({"name": "a", "children": [{"name": "a"}, {"name": "b", "optional": True}, {"name": "*"}]}) == {"a": 2}
    loaded = patterns.load_patterns('{"ignore_names": [";"], "patterns": [{"id": 2, "root": {}}, {"id": 1, "root": {}, "ignore_names": []}]}')
    assert [(p["id"], p["ignore_names"]) for p in loaded] == [(1, []), (2, [";"])]


def brute(rows, spec, i, binds):
    """All sets of binds under which node ``i`` of one record matches, by trying every choice."""
    r = rows[i]
    ok = lambda rule, v: rule in (None, "*") or rule == v or isinstance(rule, list) and v in rule
    if not (ok(spec.get("name"), r.name) and ok(spec.get("value"), r.value)):
        return []
    if "bind" in spec:
        if binds.get(spec["bind"], r.text) != r.text:
            return []
        binds = {**binds, spec["bind"]: r.text}
    states = [(i, binds)]
    for c in spec.get("children", []):
        far = c.get("match") == "descendant"
        step = [(j, b) for upto, bs in states for j in range(upto + 1, r.subtree_end + 1) if (far or rows[j].parent_idx == i) and rows[j].name not in patterns.IGNORED for b in brute(rows, c, j, bs)]
        states = step + (states if c.get("optional") else [])
    return [b for _, b in states]


def test_tree_patterns_against_every_choice(spark):
    import random

    rnd = random.Random(5)

    def make(depth):
        return (rnd.choice("abc("), rnd.choice("xy"), *[make(depth - 1) for _ in range(rnd.randint(0, 3) if depth else 0)])

    def spec(depth):
        out = {"name": rnd.choice(["a", "b", ["a", "c"], "*"]), "children": [spec(depth - 1) for _ in range(rnd.randint(0, 2) if depth else 0)], "match": rnd.choice(["child", "descendant"]), "optional": rnd.random() < 0.2}
        return {**out, "bind": "k"} if rnd.random() < 0.4 else out

    n = tree(spark, *[make(3) for _ in range(12)]).cache()
    by = {}
    for r in n.orderBy("id", "idx").collect():
        by.setdefault(r.id, []).append(r)
    for _ in range(8):
        s = spec(2)
        assert found(patterns.find(n, s)) == {(k, i) for k, rows in by.items() for i in range(len(rows)) if brute(rows, s, i, {})}, s


def test_generalisation(spark):
    a = ("f", "x", ("n", "1"), ("n", "2", ("k", "k")), ("m", "m"))
    b = ("f", "x", ("n", "1"), ("o", "2", ("k", "k")))
    n = generalize.addressed(tree(spark, a, b), 2).select(F.lit("c").alias("cluster"), F.col("id").alias("tree"), "address", "name", "value")
    got = {r.address: (r.kind, r.name, r.value) for r in generalize.anti_unify(n).collect()}
    assert got == {"0": ("concrete", "f", "x"), "0.00000": ("concrete", "n", "1"), "0.00001": ("node_hole", None, None), "0.00002": ("tail_hole", None, None)}
    s = tree(spark, a, b, ("f", "z", ("n", "1"), ("m", "m"))).select(F.lit("c").alias("cluster"), F.col("id").alias("tree"), "idx", "parent_idx", "name", "value")
    got = {r.address: (r.name, r.value, r.support) for r in generalize.skeletons(s).collect()}
    assert got == {"0": ("f", "x", 3), "0.00000": ("n", "1", 3)}


def test_alignment_against_every_choice():
    import itertools
    import random

    assert generalize.alignment(list("abc"), list("xbc")) == [(1, 1), (2, 2)]
    rnd = random.Random(2)
    for _ in range(200):
        a, b = ([rnd.choice("abc") for _ in range(rnd.randint(0, 6))] for _ in range(2))
        got = generalize.alignment(a, b)
        assert all(a[i] == b[j] for i, j in got) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(got, got[1:]))
        longest = max(k for k in range(7) if any(any(list(x) == list(y) for y in itertools.combinations(b, k)) for x in itertools.combinations(a, k)))
        assert len(got) == longest


def test_dispatch(spark):
    rows = [("a", True, False, False)] * 2 + [("b", True, True, False), ("b", False, True, False), ("c", True, False, False), ("c", False, True, False), ("d", True, True, True)]
    df = spark.createDataFrame(rows, "g string, node boolean, npm boolean, playwright boolean")
    assert {r.g: r.env for r in scoring.dispatch(df, "g", ["node", "npm", "playwright"]).collect()} == {"a": "node", "b": "npm", "c": "mixed_env", "d": "insufficient_pair"}


def test_history_is_cut_at_any_height():
    import random

    rnd = random.Random(6)
    for _ in range(20):
        ids = list(range(9))
        sims = {(a, b): rnd.choice([0.5, 0.6, 0.7, 0.8, 0.9]) for a in ids for b in ids if a < b and rnd.random() < 0.7}
        history = similarity.merge_history(ids, sims, 0.5)
        for tau in (0.5, 0.6, 0.75, 0.9):
            cut = similarity.cut_history(ids, history, tau)
            assert cut == similarity.agglomerate(ids, sims, tau)
            assert all(sims.get((a, b), 0) >= tau for c in cut for a in c for b in c if a < b)
    with pytest.raises(ValueError):
        similarity.cut_history([1, 2, 3], [(0.5, 1, 2), (0.6, 1, 3)], 0.4)


def test_anchored_generalisation(spark):
    small = ("s", "1")
    a = ("p", "x", ("f", "u", ("k", "1"), ("k", "2")), small)
    b = ("q", "y", ("f", "u", ("k", "1"), ("k", "2")), small)
    t = generalize.addressed(tree(spark, a, b), 2).select(F.lit("c").alias("cluster"), F.col("id").alias("tree"), "idx", "subtree_end", "address", "name", "value")
    got = [(r.anchor, r.address, r.kind, r.value) for r in generalize.anti_unify_anchored(t).orderBy("address").collect()]
    assert got == [("f", "0", "concrete", "u"), ("f", "0.00000", "concrete", "1"), ("f", "0.00001", "concrete", "2")]


def test_shards_and_texts(spark, tmp_path):
    from treeloom.sources import files

    one, two = spark.createDataFrame([(1, "a")], "k long, value string"), spark.createDataFrame([(2, "b")], "k long, value string")
    assert files.merge_shards([one, two], ["k"]).count() == 2
    with pytest.raises(ValueError):
        files.merge_shards([one, one], ["k"])
    files.write_texts(files.merge_shards([one, two], ["k"]), str(tmp_path / "t"), ["k"])
    assert sorted(p.name for p in (tmp_path / "t").glob("k=*")) == ["k=1", "k=2"]


def test_permutations_are_free(spark):
    members = spark.createDataFrame([(k, str(k % 3)) for k in range(60)], "key long, cluster string")
    got = scoring.permuted(members, 20, 1).collect()
    assert len(got) == 1200 and len({(r.iteration, r.key) for r in got}) == 1200
    assert all(sum(r.cluster == c and r.iteration == i for r in got) == 20 for c in "012" for i in range(20))
    assert len({r.cluster for r in got if r.key == 0}) == 3
    one = scoring.permutation_scores(members, spark.createDataFrame([("t:1", 3), ("t:1", 6)], "target string, key long"), 2, 1).collect()
    assert {(r.target, r.iteration, r.r_union) for r in one} == {("t:1", 0, 1.0), ("t:1", 1, 1.0)}


def test_mann_whitney_against_all_pairs(spark):
    import random

    rnd = random.Random(4)
    a, b = [float(rnd.randint(0, 9)) for _ in range(14)], [float(rnd.randint(2, 12)) for _ in range(11)]
    df = spark.createDataFrame([(1, 0, v) for v in a] + [(1, 1, v) for v in b], "g int, side int, v double")
    r = statistics.mann_whitney(df, ["g"], "side", "v").first()
    u = sum((x > y) + 0.5 * (x == y) for x in a for y in b)
    ties = sum(t**3 - t for t in (sorted(a + b).count(v) for v in set(a + b)))
    n = len(a) + len(b)
    sd = math.sqrt(len(a) * len(b) / 12 * (n + 1 - ties / (n * (n - 1))))
    z = (max(u, len(a) * len(b) - u) - len(a) * len(b) / 2 - 0.5) / sd
    assert r.u == u and r.p_value == pytest.approx(math.erfc(z / math.sqrt(2)))


def test_errors_and_sarif(spark, tmp_path):
    from treeloom.sources import files

    df = spark.createDataFrame([("Cannot find module 'x'; TypeError",), ("FATAL JavaScript heap out of memory",), ("TypeError",), ("",), (None,)], "e string")
    assert [r[0] for r in df.select(values.error_class(F.col("e"))).collect()] == ["ModuleNotFound", "OutOfMemory", "TypeError", "OtherError", "OtherError"]
    (tmp_path / "r.sarif").write_text('{"version": "2", "runs": [{"results": [{"ruleId": "a", "message": {"text": "m"}, "locations": []}, {"ruleId": "b", "message": {"text": "m"}, "locations": [{"physicalLocation": {"artifactLocation": {"uri": "a%20b+c.js"}, "region": {"startLine": 3}}}, {"physicalLocation": {"artifactLocation": {"uri": "z"}, "region": {"startLine": 9}}}]}]}, {"results": []}]}')
    assert [(r.id, r.rule_id, r.file_path, r.start_line, r.end_line, r.severity) for r in files.read_sarif(spark, str(tmp_path / "r.sarif")).collect()] == [(1, "b", "a b+c.js", 3, 3, "warning")]


def test_markup():
    assert [markup.category(h) for h in ("text only", '<script src=""></script>', '<script type="application/x-javascript">x</script>', " \n")] == ["inline_only", "inline_only", "with_dom", "empty"]
    assert [markup.category(h) for h in ("", "<script>a()</script>", '<script src="x.js"></script>', "<div></div>", '<script type="text/template">x</script>')] == ["empty", "inline_only", "external_only", "with_dom", "with_dom"]


def test_stream_upsert(spark, tmp_path):
    from treeloom.streaming import upsert

    src = str(tmp_path / "in")
    spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "c", 1)], "k long, v string, at long").write.parquet(src)
    stream = spark.readStream.schema("k long, v string, at long").parquet(src)
    q = upsert.upsert_stream(stream, str(tmp_path / "out"), str(tmp_path / "ck"), ["k"], "at")
    q.awaitTermination(60)
    assert {(r.k, r.v) for r in upsert.read_version(spark, str(tmp_path / "out"), 0).collect()} == {(1, "b"), (2, "c")}


def test_addresses_and_ids(spark):
    paths = spark.createDataFrame([("a/b/12/",), ("a",), ("12",), ("a/1x",), ("",), (None,), ("a/99999999999999999999",)], "p string")
    got = [r[0] and tuple(r[0]) for r in paths.select(ingest.slug_revision(F.col("p"))).collect()]
    assert got == [("a/b", 12), ("a", 1), ("12", 1), ("a/1x", 1), ("", 1), None, ("a", None)]
    names = spark.createDataFrame([("block_slow_12",), ("x/slow_3.js",), ("xslow_4",), ("slow_1_slow_2",), ("fast",), (None,)], "n string")
    assert [r[0] for r in names.select(ingest.slow_id(F.col("n"))).collect()] == [12, 3, 4, 2, None, None]
    maps = spark.createDataFrame([({"a": "x", "b": None},), (None,)], "m map<string,string>")
    assert [r[0] and (len(r[0]["a"]), r[0]["b"]) for r in maps.select(ingest.hashed(F.col("m"))).collect()] == [(64, None), None]


def test_snippets(spark):
    files = spark.createDataFrame([("a.js", "one\r\ntwo\rthree\n"), ("empty.js", ""), ("null.js", None), ("blank.js", "x\n\n")], "path string, value string")
    cases = {
        ("a.js", 1, 1): "one",
        ("/a.js", 2, 3): "two\nthree",
        ("a.js", 3, 4): ingest.NO_LINES,
        ("a.js", 0, 1): ingest.NO_LINES,
        ("a.js", 3, 2): "",
        ("empty.js", 1, 1): ingest.NO_LINES,
        ("null.js", 1, 0): "",
        ("blank.js", 1, 2): "x\n",
        ("b.js", 1, 1): ingest.NO_FILE,
        ("build/a.js", 1, 1): ingest.SKIPPED,
        ("/build/a.js", 1, 1): ingest.NO_FILE,
        (None, 1, 1): ingest.NO_FILE,
    }
    df = spark.createDataFrame([(*k, "kept") for k in cases], "file_path string, start_line int, end_line int, value string")
    got = ingest.with_snippets(df, files)
    assert got.columns == ["file_path", "start_line", "end_line", "value", "code_snippet"]
    assert {tuple(r)[:3]: r.code_snippet for r in got.collect()} == cases


def test_single_difference(spark):
    def plain(a, b):
        shorter, p, s = min(len(a), len(b)), 0, 0
        while p < shorter and a[p] == b[p]:
            p += 1
        while s < shorter - p and a[-1 - s] == b[-1 - s]:
            s += 1
        left = [x[p : len(x) - s] for x in (a, b)]
        return p, s, all(len(x) == 1 and x[0].islower() for x in left)

    import itertools

    sides = [list(x) for n in range(4) for x in itertools.product("aB", repeat=n)]
    rows = [(a, b) for a in sides for b in sides]
    df = spark.createDataFrame(rows, "a array<string>, b array<string>")
    typed = lambda c: F.transform(c, lambda t: F.struct(t.alias("text"), F.when(F.lower(t) == t, "ExpressionStatement").otherwise("Block").alias("type")))
    got = df.select("a", "b", ingest.single_difference(typed(F.col("a")), typed(F.col("b"))).alias("d")).collect()
    assert [tuple(r.d) for r in got] == [plain(r.a, r.b) for r in got]


def test_outcomes(spark):
    before = spark.createDataFrame([(1, True), (2, False), (3, True), (4, True)], "k int, ok boolean")
    after = spark.createDataFrame([(1, True), (2, True), (3, False), (5, True), (6, None)], "k int, ok boolean")
    assert tuple(ingest.outcome_changes(before, after, ["k"]).first()) == (2, 1)
    results = spark.createDataFrame([(["a", "b"], True), (["a"], False), ([], True), (None, True)], "libs array<string>, ok boolean")
    assert sorted(map(tuple, ingest.involvement(results, "libs").collect())) == [("a", 2, 1), ("b", 1, 1)]


def test_stored_nodes_are_neither_broadcast_nor_dealt_again(spark):
    from treeloom.operators import selection, storage

    rows = [(i, s, k, -1 if k == 0 else 0, 2 if k == 0 else k, "x", f"v{k}") for i in range(40) for s in ("base", "head") for k in range(3)]
    key = ("id", "side", "idx")
    n = storage.stored(spark.createDataFrame(rows, "id long, side string, idx int, parent_idx int, subtree_end int, name string, value string"), "some-nodes", key)
    cut = storage.stored(n.where("idx > 0").select(*key, F.lit("Diff").alias("scope")), "some-cut", key)
    got = selection.candidates(n, cut)
    with storage._layout(spark):
        got = got.select("*")
        plan = got._jdf.queryExecution().executedPlan().toString()
    # the files take a few KB, far below the size from which Spark broadcasts
    assert "Broadcast" not in plan and "Exchange" not in plan
    assert {(r.id, r.side, *r.nodes, *r.tokens) for r in got.collect()} == {(i, s, 1, 2, "v1", "v2") for i in range(40) for s in ("base", "head")}
    assert spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition") == "true"


def test_matches_stay_with_their_program(spark):
    import os

    from treeloom.operators import storage, syntax
    from treeloom.plans import programs, syntax_catalog

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no test data")
    f = syntax_catalog.facts(spark, sf)
    m, c = syntax_catalog.matched(f)
    acts = programs.actions(f)
    with storage._layout(spark):
        for df in (syntax.calls(f), syntax.find_slow_forms(f, c), syntax.query_hits(f, c), syntax.base_covered(m.drop("confidence"), f, acts)):
            plan = df.select("*")._jdf.queryExecution().executedPlan().toString()
            assert "Exchange" not in plan, df.columns


def test_links_stay_with_their_program(spark, monkeypatch):
    import os

    from treeloom.operators import storage
    from treeloom.plans import syntax_catalog

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no test data")
    plans, write = {}, syntax_catalog.stored

    def seen(df, label, by=()):
        with storage._layout(spark):
            plans[label] = df.select("*")._jdf.queryExecution().executedPlan().toString()
        return write(df, label, by)

    monkeypatch.setattr(syntax_catalog, "stored", seen)
    f = syntax_catalog.facts(spark, sf)
    links = syntax_catalog.linked(f)
    syntax_catalog.program_query_hits(spark, sf)
    assert {"calls", "matches", "after", "links", "hits"} <= set(plans)
    for label in ("calls", "matches", "after", "links", "hits"):
        assert "Exchange" not in plans[label], label
    # the children without punctuation aren't written beside the children
    assert "named" not in {c for c in spark.read.parquet(*f.inputFiles()[:1]).columns} and "named" in f.columns
    # one file a bucket at most, whatever the number of forms
    for df in (links, syntax_catalog.matched(f)[0]):
        assert len(df.inputFiles()) <= storage.buckets(spark)


def _written(spark, monkeypatch, name):
    """The tables that a query writes, by label; links themselves are left empty."""
    import os

    from treeloom.plans import syntax_catalog

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no test data")
    tables, write = {}, syntax_catalog.stored
    monkeypatch.setattr(syntax_catalog, "stored", lambda df, label, by=(): tables.setdefault(label, write(df, label, by)))
    links = spark.createDataFrame([], "id long, side string, pattern_id int, confidence string, idx int, diff_reason string, diff_linked boolean")
    monkeypatch.setattr(syntax_catalog, "linked", lambda f: links)
    getattr(syntax_catalog, name)(spark, sf)
    return tables


def _lean(f):
    """No bare tokens but a statement's first, and no columns that nothing reads."""
    assert f.where("size(kids) = 0 and name = value and rel > 1").isEmpty() and not f.where("size(kids) = 0 and rel <= 1").isEmpty()
    assert not {"begin", "end", "s", "consequence"} & set(f.columns)


def test_summary_writes_lean_facts(spark, monkeypatch):
    _lean(_written(spark, monkeypatch, "program_link_summary")["facts"])


def test_query_hits_write_lean_facts(spark, monkeypatch):
    f = _written(spark, monkeypatch, "program_query_hits")["facts"]
    assert not {"parent_idx", "rel", "lhs", "rhs", "begin", "end"} & set(f.columns)
    assert f.where("size(kids) = 0 and name in (')', ';', '}')").count() == 0


def test_links_write_lean_facts(spark, monkeypatch):
    _lean(_written(spark, monkeypatch, "program_diff_links")["facts"])


def test_totals_write_lean_facts_and_no_begins(spark, monkeypatch):
    tables = _written(spark, monkeypatch, "program_pattern_totals")
    _lean(tables["facts"])
    assert "begins" not in tables

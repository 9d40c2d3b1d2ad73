"""The context pack on a small project, with numbers worked out by hand."""

import math

import pytest
from pyspark.sql import functions as F

from codemap_spark.operators import context, memory, packs, ranking, substrings

QUERY, TOKENS = "login session", ["login", "session"]


@pytest.fixture(scope="module")
def project(spark):
    files = spark.createDataFrame(
        [
            (1, "src/login/session_handler.py", "python", "source"),
            (2, "docs/login.md", "markdown", "documentation"),
            (3, "tests/test_login.py", "python", "test"),
            (4, "src/auth/sessions.py", "python", "source"),
            (5, "assets/login.css", "css", "asset"),
        ],
        "id long, path string, language string, role string",
    )
    symbols = spark.createDataFrame([(10, 1, "LoginSession", "class", 3), (20, 2, "Login guide", "heading", 1), (30, 4, "helper", "function", None)], "id long, file_id long, name string, kind string, line int")
    commits = spark.createDataFrame([(7, "2024-02-01", "Fix login"), (8, "2024-01-01", "Other")], "id long, date string, message string")
    commit_files = spark.createDataFrame([(7, "src/login/session_handler.py"), (7, "gone/x.py"), (8, "docs/login.md")], "commit_id long, path string")
    feedback = spark.createDataFrame([(1, "src/auth/sessions.py", "useful", "user", QUERY), (2, "assets/login.css", "noisy", "agent", QUERY)], "id long, path string, rating string, source string, query string")
    relations = spark.createDataFrame(
        [
            (1, "file", 3, "calls", "symbol_name", "start_session", 0.45, "{}"),
            (2, "file", 3, "includes", "file", "src/login/session_handler.py", 0.8, "{}"),
            (3, "file", 3, "includes", "file", "no/such.py", 0.8, "{}"),
        ],
        "id long, source_type string, source_id long, relation string, target_type string, target_id string, confidence double, metadata string",
    )
    return files, symbols, commits, commit_files, feedback, relations


def pack_of(project, weights, query=QUERY):
    files, symbols, commits, commit_files, feedback, relations = project
    return ranking.context_pack(files, symbols, commits, commit_files, memory.feedback_signals(feedback, files, query), weights, relations=relations)


def test_scores(project):
    rows = pack_of(project, ranking.flat(TOKENS)).collect()
    want = {
        # (7 + 7 path, 5 file name, 2 x 3.5 symbols, 1.2 + 0.8 commit, 0.5 related) x 1.05 + 0.1
        "src/login/session_handler.py": 28.5 * 1.05 + 0.1,
        # (4 inside the name, 2.5 x 0.9 and 2 x 0.9 nearly) x 1.05 + 0.1, and 10 x 1.2 as useful
        "src/auth/sessions.py": 8.05 * 1.05 + 0.1 + 12,
        "tests/test_login.py": (12 + 2.2) * 0.45,
        "docs/login.md": (12 + 3.5 * 0.25) * 0.4,
        "assets/login.css": (12 * 0.7 - 3) * 0.35,
    }
    assert [r.path for r in rows] == list(want)
    assert [r.raw for r in rows] == pytest.approx(list(want.values()), abs=1e-6)
    assert [r.score for r in rows] == [round(v / 30.025, 2) for v in want.values()]


def test_weights_by_source(project):
    files, symbols, commits, *_ = project
    stats = context.all_term_stats(files, symbols, commits)
    rows = {(r.term, r.source): (r.document_count, r.total_count, r.weight) for r in stats.collect()}
    weight = lambda n, df: round(min(2.8, max(0.25, 0.45 + math.log((n + 1) / (df + 1)))), 6)
    assert rows["login", "path"] == (4, 4, weight(5, 4)) and rows["login", "filename"] == (3, 3, weight(5, 3))
    assert rows["login", "symbol"] == (2, 2, weight(3, 2)) and rows["login", "commit"] == (1, 1, weight(2, 1))
    assert rows["login", "all"] == (10, 10, weight(25, 10))
    found = context.query_weights(stats, ["login", "absent"], None)
    assert found["absent"] == {"all": 0.25} and ranking.weight(found, "login", "role") == found["login"]["all"]
    scored = {r.path: r.score for r in ranking.path_scores(files, found).collect()}
    assert scored["docs/login.md"] == pytest.approx(7 * found["login"]["path"] + 5 * found["login"]["filename"])
    none = context.query_weights(stats, ["absent"], context.source_documents(files, symbols, commits))
    assert none == {"absent": {"all": 2.4}}


def test_reasons_and_diagnosis(project):
    files, symbols, commits, commit_files, feedback, relations = project
    weights = ranking.flat(TOKENS)
    pack = pack_of(project, weights)
    reasons = context.pack_reasons(pack, files, symbols, commits, commit_files, feedback, relations, files.select("path"), weights, QUERY)
    found = {r.path: r.reasons for r in reasons.collect()}
    assert found["src/login/session_handler.py"] == [
        'path matches "login"', 'common token "login" downweighted', 'path matches "session"', 'common token "session" downweighted', 'filename matches "session"', 'symbol matches "login"',
        'symbol matches "session"', 'commit message matches "login"',
    ]
    assert found["src/auth/sessions.py"] == [
        "previously marked useful for similar query", 'filename contains "session"', 'common token "session" downweighted', 'path softly matches "session"', 'filename softly matches "session"', "source file preferred",
    ]
    assert found["tests/test_login.py"][:4] == ["test file deprioritized for non-test query", 'path matches "login"', 'common token "login" downweighted', 'filename matches "login"']
    assert found["tests/test_login.py"][4:6] == ['calls "start_session"', 'common token "session" downweighted']
    assert found["assets/login.css"][:2] == ["previously marked noisy for similar query", "asset file deprioritized for non-UI query"]
    rows = [(r.part, r.name, r.text) for r in context.diagnose(pack, reasons, QUERY, TOKENS).orderBy("part", "position").collect()]
    assert ("level", "high", "") in rows and ("action", "inspect_top_candidate", "codemap related src/login/session_handler.py") in rows


def test_diagnosis_of_weak_packs(spark):
    rows = [(f"a{i}/view.py", "source", 9.0 - i, 0.9, ['path softly matches "logging"']) for i in range(6)] + [("tests/t.py", "test", 1.0, 0.9, ['path softly matches "logging"'])]
    listed = spark.createDataFrame(rows, "path string, role string, raw double, score double, reasons array<string>")

    def found(rows, query, tokens):
        out = context.diagnose(rows.drop("reasons"), rows.select("path", "reasons"), query, tokens).orderBy("position").collect()
        return {part: [(r.name, r.text) for r in out if r.part == part] for part in ("level", "reason", "action")}

    weak = found(listed, 'a "b" test', ["test"])
    assert weak["level"] == [("low", "")] and [n for n, _ in weak["reason"]] == [context.SIMILAR, context.UNSUPPORTED, context.SOFT_PATHS, context.HIGH_LEVEL]
    assert weak["action"][0] == ("inspect_failing_test_neighborhood", "codemap related tests/t.py")
    assert weak["action"][3] == ("narrow_query", 'codemap run "a \\"b\\" test" --markdown')
    assert found(listed.limit(0), "q", ["q"])["reason"] == [(context.NO_CANDIDATES, "")]
    medium = found(listed.withColumn("reasons", F.array(F.lit('calls "x"'))), "q", ["q"])
    assert medium["level"] == [("medium", "")] and [n for n, _ in medium["reason"]] == [context.SIMILAR] and [n for n, _ in medium["action"]][0] == "check_index"


def test_related_symbols(project):
    files, symbols, *_ = project
    few = files.where("id = 4").select("path")
    rows = [(r.name, r.score) for r in ranking.related_symbols(symbols, files, TOKENS, few).collect()]
    assert rows == [("Login guide", 3), ("LoginSession", 3), ("helper", 1)]


def test_soft_matches_like_brute_force(spark):
    import difflib

    tokens = ["widgets", "gadgett", "sprockets", "sessionhandler", "red", "project"]
    terms = "widget widgets wigdets gadget gadgets sprocket rocket session handler sessionhandlers handle abcde stekcorps sprockest project projects".split()
    noise = {"project", "handle"}

    def best(a, b):
        if len(a) < 6 or len(b) < 5 or a in noise or b in noise:
            return 0.0
        short, long = sorted((a, b), key=len)
        share = len(short) / len(long)
        if len(short) >= 6 and share >= 0.5 and long.startswith(short):
            return 0.9
        if len(short) >= 6 and share >= 0.65 and short in long:
            return 0.84
        ratio = difflib.SequenceMatcher(None, a, b).ratio()
        return ratio if ratio >= 0.82 else 0.0

    pairs = spark.createDataFrame([(a, b) for a in tokens for b in terms], "token string, candidate string")
    found = {(r.token, r.candidate): r.score for r in ranking.soft_matches(pairs).collect()}
    assert {k: pytest.approx(v) for k, v in found.items() if v} == {(a, b): best(a, b) for a in tokens for b in terms if best(a, b)}


def test_substrings_like_brute_force(spark):
    names = ["login session", "log", "aaa aaab", "日本語 text", "", "x", "session.py"]
    tokens = ["log", "session", "a", "aa", "aab", "本語", "zzz", "x", ".", "ses sion", "login session", ""]
    n, t = spark.createDataFrame([(x,) for x in [*names, None]], "name string"), spark.createDataFrame([(x,) for x in tokens], "token string")
    assert {tuple(r) for r in substrings.containing(n, t).collect()} == {(a, b) for a in names for b in tokens if b and b in a}
    looked = {r.token: r.candidates for r in substrings.rarest(n, t).collect()}
    assert looked["login session"] == 1 and looked["session"] == 2 and "zzz" not in looked
    assert substrings.containing(n.limit(0), t).count() == substrings.containing(n, t.limit(0)).count() == 0


def test_packs_of_many_queries_like_each_alone(spark, project):
    files, symbols, commits, commit_files, feedback, relations = project
    queries = ["login session", "logins handler", "test login css", "docs of the start", "zzz yyy", "the", "sessions sql migration"]
    asked = spark.createDataFrame([(f"q{i}", q) for i, q in enumerate(queries)], "name string, query string")
    stats = context.all_term_stats(files, symbols, commits)
    texts = context.source_documents(files, symbols, commits).where("source in ('path', 'symbol', 'commit')")
    columns = ("path", "language", "role", "raw", "score")
    found = {}
    for r in packs.context_packs(files, symbols, commits, commit_files, relations, feedback, asked, stats, texts, limit=3).orderBy("rank").collect():
        found.setdefault(r.name, []).append(tuple(r[c] for c in columns))
    for i, q in enumerate(queries):
        tokens = spark.range(1).select(packs.T.query_tokens(F.lit(q)).alias("t")).first().t
        want = []
        if tokens:
            weights = context.query_weights(stats, tokens, texts)
            alone = ranking.context_pack(files, symbols, commits, commit_files, memory.feedback_signals(feedback, files, q), weights, 3, relations)
            want = [tuple(r[c] for c in columns) for r in alone.orderBy(F.desc("raw"), "path").collect()]
        assert [x[:3] for x in found.get(f"q{i}", [])] == [x[:3] for x in want] and [x[3:] for x in found.get(f"q{i}", [])] == [pytest.approx(x[3:]) for x in want], q
    assert packs.context_packs(files, symbols, commits, commit_files, relations, feedback, asked.limit(0), stats, texts).count() == 0


def test_related_files_of_many_queries_like_each_alone(spark):
    """Targets that one path, several paths (of one file name), or none answer to."""
    from codemap_spark.operators.relations import related_scores

    paths = ["a/x.py", "b/x.py", "c/x.py", "a/y.py", "z.py"]
    files = spark.createDataFrame(list(enumerate(paths)), "id long, path string")
    edges = [(0, "./x.py"), (1, "x.py"), (3, "b/x.py"), (4, "q/x.py"), (4, "a/y.py"), (2, "none"), (2, None), (3, "a/y.py"), (0, "z.py"), (0, "z.py")]
    relations = spark.createDataFrame(edges, "source_id long, target_id string")
    lists = {1: ["b/x.py", "c/x.py", "z.py"], 2: ["a/x.py", "a/y.py"], 3: paths, 4: ["gone/x.py"]}
    candidates = spark.createDataFrame([(p, [q for q, own in lists.items() if p in own]) for p in [*paths, "gone/x.py"]], "path string, names array<bigint>")
    found = {(r.name, r.path): r.score for r in packs._related(relations, files, candidates).collect()}
    want = {(q, r.path): r.score for q, own in lists.items() for r in related_scores(relations, files, spark.createDataFrame([(p,) for p in own], "path string")).collect()}
    assert found == want and want


def test_a_commit_is_one_row_a_file_for_all_queries(spark, project):
    files, symbols, commits, commit_files, _, relations = project
    w = {k: 1.0 for k in packs.SOURCES}
    weights = spark.createDataFrame([(q, "login", w) for q in range(20)], "name long, token string, w struct<" + ",".join(f"{k}:double" for k in packs.SOURCES) + ">")
    wants = spark.createDataFrame([(q, False) for q in range(20)], "name long, docs boolean")
    points, worth = packs._points(files, symbols, commits, commit_files, relations, weights, wants, False)
    assert sorted(r.path for r in points.where("key % 2 = 1").collect()) == ["gone/x.py", "src/login/session_handler.py"]
    assert {r.worth for r in worth.where("key % 2 = 1").collect()} == {2.0} and worth.where("key % 2 = 1").count() == 20


def test_equal_related_symbols_are_listed_by_id(spark):
    files = spark.createDataFrame([(1, "a.py")], "id long, path string")
    symbols = spark.createDataFrame([(k, 1, "red rod", f"kind{k}", 1) for k in (7, 3, 9, 1, 5)], "id long, file_id long, name string, kind string, line int")
    found = ranking.related_symbols(symbols.repartition(3), files, ["red"], files.select("path"), limit=2).collect()
    assert [r.kind for r in found] == ["kind1", "kind3"]


def test_tasks_of_many_queries_follow_paths_and_queries(spark, monkeypatch):
    """A list of queries is a few bytes a path in a shuffle, but many rows."""
    paths = spark.range(1000).select(F.concat(F.lit("p"), "id").alias("path"))
    monkeypatch.setattr(packs, "PAIRS", 100)
    few, many = packs._tasks(paths, spark.range(1)), packs._tasks(paths, spark.range(100))
    assert few < 50 and 900 <= many <= 1100


def test_matched_symbols_are_the_first_by_id_whatever_their_kind(spark):
    rows = [(1, 9, "red_a", "class"), (1, 4, "RED_b", "heading"), (1, 4, "red_c", "class"), (1, 7, "widget", "method"), (2, None, "redwidget", "heading"), (2, 1, "red", "class"), (3, 5, None, "class"), (4, 6, "blue", "class"), (9, 1, "red", "class")]
    symbols = spark.createDataFrame([(f, i, n, k) for f, i, n, k in rows], "file_id long, id long, name string, kind string")
    files = spark.createDataFrame([(k, f"p{k}", "documentation") for k in (1, 2, 3, 4)], "id long, path string, role string")
    found = {(r.file_id, r.token): (r.id, r.share) for r in ranking.matched_symbols(symbols, files, ["red", "widget"]).collect()}
    assert found == {(1, "red"): (4, 0.5), (1, "widget"): (7, 0.5), (2, "red"): (None, 0.25), (2, "widget"): (None, 0.25)}
    assert ranking.matched_symbols(symbols, files, []).count() == 0
    # rows are combined by a hash and not sorted one by one
    plan = ranking.matched_symbols(symbols, files, ["red"])._jdf.queryExecution().sparkPlan().toString()
    assert "HashAggregate(keys=[file_id" in plan


def test_commit_files_of_some_commits_are_those_of_all(spark):
    from codemap_spark.sources import corpus as C

    sf = "/root/testdata/sf0.001"
    asked = ranking.matched_commits(C.commits(spark, sf), ["red", "widget"])
    ids = {r.id for r in asked.collect()}
    want = sorted(tuple(r) for r in C.commit_files(spark, sf).collect() if r.commit_id in ids)
    assert want and sorted(tuple(r) for r in C.commit_files(spark, sf, among=asked).collect()) == want


def test_the_bound_on_soft_matches_drops_only_what_scores_nothing(spark):
    import difflib
    import itertools

    words = ["widget", "widgets", "gadget", "gadgett", "budget", "sprocket", "sprockets", "rockets", "123456", "99999", "handler", "handlers", "hand", "configuration", "config", "reconfigure", "tegdiw", "w1dget", "widgetwidget"]
    pairs = spark.createDataFrame(list(itertools.product(words, words)), "token string, candidate string")
    scored = {(r.token, r.candidate): r.score for r in ranking.soft_matches(pairs).collect()}
    for t in words:
        may = {r.candidate: r.may for r in pairs.select("candidate", ranking._may_match(t, pairs.candidate).alias("may")).distinct().collect()}
        assert not [c for c in words if scored.get((t, c), 0) > 0 and not may[c]]
        assert all(may[c] for c in words if len(c) > 5 and difflib.SequenceMatcher(None, t, c).ratio() >= 0.82)
    assert not any(r.may for r in pairs.where("candidate in ('123456', '99999')").select(ranking._may_match("widget", pairs.candidate).alias("may")).collect())
    files = spark.createDataFrame([(k, f"src/widgets_{k + 100000}.py") for k in range(20)], "id long, path string")
    assert {(r.token, r.in_name) for r in ranking.soft_path_matches(files, ["widget"]).collect()} == {("widget", 0.9)}


def test_a_diagnosis_scores_its_files_once(spark, monkeypatch):
    from codemap_spark.plans import catalog

    written, kept = [], catalog.stage
    monkeypatch.setattr(catalog, "stage", lambda df, name: (written.append(name), kept(df, name))[1])
    assert catalog.QUERIES["context_diagnostics"](spark, "/root/testdata/sf0.001").count() > 0
    assert written.count("pack-scores") == 1 and "pack-candidates" not in written and "project-commit_files" not in written


def test_read_sizes_shuffle_no_texts(spark, monkeypatch):
    from codemap_spark.operators import stats
    from codemap_spark.plans import catalog

    seen = []
    kept = stats.read_sizes
    monkeypatch.setattr(stats, "read_sizes", lambda files, pack: (seen.append(files.columns), kept(files, pack))[1])
    assert catalog.QUERIES["read_sizes"](spark, "/root/testdata/sf0.001").count() == 3
    assert "content" not in seen[0]
    files = spark.createDataFrame([("a.py", "python", "source", "abcdé"), ("b.x", "unknown", "asset", "xy"), ("c.py", "python", "source", None)], "path string, language string, role string, content string")
    pack = spark.createDataFrame([("a.py", 2.0), ("b.x", 1.0)], "path string, raw double")
    rows = lambda f: sorted(tuple(r) for r in kept(f, pack).collect())
    short = files.selectExpr("path", "language", "role", "char_length(content) AS length")
    assert rows(files) == rows(short) == [("indexed_project", 2, 5, 2), ("suggested_first_reads", 2, 7, 2), ("top_candidates", 2, 7, 2)]

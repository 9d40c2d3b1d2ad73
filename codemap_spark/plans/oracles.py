"""DuckDB SQL with the same rows as the catalog's queries."""

from __future__ import annotations

from ..functions import lexicon as L


def _list(values) -> str:
    return ", ".join("'" + v + "'" for v in values)


def _noise(t: str) -> str:
    return f"({t} IN ({_list(L.NOISE)}) OR (length({t}) < 3 AND {t} NOT IN ({_list(L.SHORT_TECH)})))"


_MACROS = {
    "paths": """part200 AS (SELECT p_partkey AS name_key, p_name FROM part WHERE p_partkey < 200),
        paths AS (SELECT doc_id AS id, (CASE WHEN doc_id % 11 = 0 THEN 'tests/' ELSE '' END) || source || '/' || lang || '/' || replace(p_name, ' ', '_') || '_' || doc_id || '.' ||
            ['py', 'php', 'js', 'sql', 'md', 'css', 'json', 'rs'][doc_id % 8 + 1] AS path FROM documents JOIN part200 ON doc_id % 200 = name_key)""",
    "files": f"""named AS (SELECT id, path, lower(list_last(string_split(path, '/'))) AS name, lower(regexp_extract(path, '[^/.][^/]*([.][^./]+)$', 1)) AS ext, lower(path) AS low FROM paths),
        files AS (SELECT id, path, coalesce(map_extract(MAP {{{", ".join(f"'{k}': '{v}'" for k, v in L.LANGUAGES.items())}}}, ext)[1], 'unknown') AS language,
            CASE WHEN name IN ({_list(L.CONFIG_NAMES)}) OR contains(name, 'config') OR ext IN ('.toml', '.yaml', '.yml', '.json') THEN 'config'
                 WHEN starts_with(name, 'readme') OR ext IN ('.md', '.rst') OR contains(low, '/docs/') THEN 'documentation'
                 WHEN ext IN ({_list(L.ASSET_SUFFIXES)}) THEN 'asset'
                 WHEN list_has_any(string_split(low, '/'), [{_list(L.TEST_PARTS)}]) OR starts_with(name, 'test_') THEN 'test'
                 WHEN contains(low, 'migration') THEN 'migration' WHEN contains(low, 'route') THEN 'route'
                 WHEN contains(low, '/views/') OR contains(low, '/templates/') OR ext IN ('.html', '.tsx', '.jsx') THEN 'view'
                 WHEN ext IN ({_list(L.SOURCE_SUFFIXES)}) THEN 'source' ELSE 'unknown' END AS role FROM named)""",
    "content": "content AS (SELECT id, path, language, role, octet_length(encode(text)) AS size, sha256(text) AS sha256, text AS content FROM files JOIN documents ON id = doc_id)",
    "symbols": """symbols AS (SELECT l_suppkey * 1000000 + l_partkey AS id, l_suppkey AS file_id, p_name AS name, ['function', 'method', 'class', 'heading'][p_partkey % 4 + 1] AS kind, p_size AS line
        FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem) JOIN part ON l_partkey = p_partkey)""",
    "commits": """commits AS (SELECT o_orderkey AS id, o_custkey AS author, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS date, concat_ws(' ', o_orderpriority, p_name) AS message
        FROM orders LEFT JOIN part200 ON o_orderkey % 200 = name_key)""",
    "commit_files": "commit_files AS (SELECT commit_id, coalesce(path, 'part/' || l_partkey) AS path FROM (SELECT DISTINCT l_orderkey AS commit_id, l_partkey FROM lineitem) LEFT JOIN paths ON id = l_partkey)",
    "feedback": """feedback AS (SELECT doc_id AS id, (CASE WHEN doc_id % 13 = 0 THEN 'gone/' ELSE '' END) || path AS path, CASE WHEN toxic = 1 THEN 'noisy' WHEN quality = 1 THEN 'useful' ELSE 'neutral' END AS rating,
            ['agent', 'benchmark', 'user'][doc_id % 3 + 1] AS source, p_name AS query FROM labels JOIN paths ON id = doc_id JOIN part200 ON doc_id % 200 = name_key),
        likened AS (SELECT *, len(list_intersect(q, ['red', 'widget'])) / len(list_distinct(list_concat(q, ['red', 'widget']))) AS similarity FROM (SELECT *, string_split(query, ' ') AS q FROM feedback)),
        weighed AS (SELECT *, similarity * CASE rating WHEN 'useful' THEN 10.0 WHEN 'noisy' THEN -3.0 ELSE 0.0 END * CASE source WHEN 'agent' THEN 1.0 WHEN 'benchmark' THEN 1.1 ELSE 1.2 END AS c FROM likened),
        signals AS (SELECT path, round(least(30.0, sum(greatest(c, 0.0))), 6) AS boost, round(greatest(-5.0, sum(least(c, 0.0))), 6) AS penalty, count(*) AS items
            FROM weighed WHERE similarity >= 0.25 AND path IN (SELECT path FROM paths) GROUP BY path)""",
    "notes": """notes AS (SELECT conv_id * 1000 + turn AS id, coalesce(path, 'gone/' || (conv_id * 17)) AS path, CASE WHEN conv_id % 7 = 0 THEN 'repo' ELSE 'file' END AS scope, conversations.role AS topic, text AS note,
            CASE conv_id % 3 WHEN 0 THEN coalesce(sha256, '0') WHEN 1 THEN 'altered' ELSE '' END AS file_sha256, '2024-01-' || lpad(CAST(conv_id % 28 + 1 AS VARCHAR), 2, '0') AS created_at FROM conversations LEFT JOIN content ON content.id = conv_id * 17),
        stale AS (SELECT notes.*, CASE WHEN scope = 'repo' THEN NULL WHEN sha256 IS NULL THEN true WHEN file_sha256 = '' THEN NULL ELSE file_sha256 <> sha256 END AS stale,
            CASE WHEN file_sha256 = '' THEN NULL WHEN sha256 IS NULL THEN true ELSE file_sha256 <> sha256 END AS stale_dashboard FROM notes LEFT JOIN content USING (path))""",
    "items": """items AS (SELECT plan_id, row_number() OVER (PARTITION BY plan_id ORDER BY l_partkey) AS rank, 'part/' || l_partkey AS path, CASE flag WHEN 'R' THEN 'noisy' WHEN 'A' THEN 'useful' ELSE 'opened' END AS event
        FROM (SELECT l_orderkey AS plan_id, l_partkey, max(l_returnflag) AS flag FROM lineitem GROUP BY ALL))""",
    "before": """old AS (SELECT path, CASE WHEN id % 10 = 1 THEN 'altered' ELSE sha256 END AS sha256 FROM content WHERE id % 10 <> 0 UNION ALL SELECT 'removed/' || path, sha256 FROM content WHERE id % 10 = 0)""",
    "relations": """relations AS (SELECT event_id AS id, 'file' AS source_type, user_id AS source_id, ['includes', 'defines', 'calls'][event_id % 3 + 1] AS relation, ['file', 'symbol', 'symbol_name'][event_id % 3 + 1] AS target_type,
            CASE event_id % 3 WHEN 0 THEN path WHEN 1 THEN CAST((event_id % 10 + 1) * 1000000 + event_id % 200 + 1 AS VARCHAR) ELSE p_name END AS target_id, CAST(event_id % 100 AS DOUBLE) / 100 AS confidence, props AS metadata
        FROM events JOIN part200 ON event_id % 200 = name_key LEFT JOIN paths ON paths.id = event_id * 7 % (user_id * 13 + 50))""",
    "project": f"""pnamed AS (SELECT doc_id AS id, CASE doc_id % 5 WHEN 0 THEN 'src/api/' WHEN 1 THEN 'tests/' ELSE '' END || lang || '/d' || doc_id || '/' || ['main.py', '__init__.py', 'pyproject.toml', 'README.md', 'app.py', 'widget.py', 'Makefile', 'routes.py'][doc_id % 8 + 1] AS path, doc_id % 8 AS kind8 FROM documents),
        project AS (SELECT id, path, list_last(string_split(path, '/')) AS name, len(string_split(path, '/')) AS depth, ['python', 'python', 'toml', 'markdown', 'python', 'python', 'unknown', 'python'][kind8 + 1] AS language,
            CASE WHEN kind8 = 2 THEN 'config' WHEN kind8 = 3 THEN 'documentation' WHEN starts_with(path, 'tests/') THEN 'test' WHEN kind8 = 7 THEN 'route' WHEN kind8 = 6 THEN 'unknown' ELSE 'source' END AS role FROM pnamed),
        psymbols AS (SELECT doc_id * 10 + k AS id, doc_id AS file_id, ['main', 'widgetApp', 'setup', 'Serve', 'helper'][(doc_id + k) % 5 + 1] AS name, ['project_script', 'package_script', 'route', 'function'][(doc_id + k * 3) % 4 + 1] AS kind, k AS line
            FROM documents, range(7) t(k))""",
    "hits": """lookup AS (SELECT unnest(['red', 'widget']) AS token),
        prepared AS (SELECT id, path, role, language, list_filter(regexp_split_to_array(lower(path), '[^a-z0-9]+'), lambda x: true) AS raw, list_last(string_split(path, '/')) AS name FROM files),
        path_hits AS (SELECT path, token, (CASE WHEN list_contains(regexp_extract_all(lower(path), '[a-z]+|[0-9]+'), token) THEN 7.0 ELSE 0.0 END)
            + (CASE WHEN list_contains(regexp_extract_all(lower(name), '[a-z]+|[0-9]+'), token) THEN 5.0
                    WHEN length(token) >= 5 AND contains(regexp_replace(lower(regexp_replace(name, '[.][^.]*$', '')), '[^a-z0-9]', '', 'g'), token) THEN 4.0 ELSE 0.0 END)
            + (CASE WHEN contains(role, token) OR contains(language, token) THEN 1.5 ELSE 0.0 END) AS hit FROM prepared, lookup),
        path_scores AS (SELECT path, sum(hit) AS score FROM path_hits WHERE hit > 0 GROUP BY path)""",
}
_NEEDS = {"files": ["paths"], "content": ["files"], "commits": ["paths"], "commit_files": ["paths"], "feedback": ["paths"], "notes": ["content"], "before": ["content"], "hits": ["files"], "relations": ["paths"]}


def _with(names: list[str], body: str) -> str:
    order: list[str] = []

    def add(name: str) -> None:
        for n in _NEEDS.get(name, []):
            add(n)
        if name not in order:
            order.append(name)

    for n in names:
        add(n)
    return ("WITH " + ",\n".join(_MACROS[n] for n in order) + "\n" if order else "") + body


def _terms(text: str) -> str:
    """Terms without look-ahead: cut where the pattern would, then collect."""
    cut = f"regexp_replace(regexp_replace(replace({text}, '_', ' '), '[A-Z]+([0-9])', ' \\1', 'g'), '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g')"
    return f"list_transform(regexp_extract_all({cut}, '[A-Z]?[a-z]+|[A-Z]+|[0-9]+'), lambda x: lower(x))"


def _useful(text: str) -> str:
    return f"list_filter({_terms(text)}, lambda t: NOT {_noise('t')})"


def _distinct(terms: str) -> str:
    return f"list_filter({terms}, lambda t, i: list_position({terms}, t) = i)"


def _stats(source: str, rows: str, text: str) -> str:
    return f"""terms AS (SELECT row_number() OVER () AS r, unnest({_useful(text)}) AS term FROM {rows}),
        stats AS (SELECT term, '{source}' AS source, count(DISTINCT r) AS document_count, count(*) AS total_count,
            round(least(2.8, greatest(0.25, 0.45 + ln(((SELECT count(*) FROM {rows}) + 1) / (count(DISTINCT r) + 1)))), 6) AS weight FROM terms GROUP BY term)"""


_FIRST_READS = f"""scored AS (SELECT id, path, len(string_split(path, '/')) AS depth, role, lower(path) AS low, list_last(string_split(path, '/')) AS name FROM project),
    declared AS (SELECT file_id AS id, bool_or(kind = 'project_script') AS script, bool_or(kind = 'package_script') AS package, bool_or(kind = 'route') AS route, bool_or(kind = 'function' AND (lower(name) IN ({_list(L.ENTRY_NAMES)}) OR ends_with(lower(name), 'app'))) AS entry FROM psymbols GROUP BY file_id),
    points AS (SELECT path, depth, role,
        CASE WHEN name IN ({_list(L.MANIFESTS)}) THEN CASE WHEN depth = 1 THEN 12 ELSE 4 END ELSE 0 END + CASE WHEN starts_with(lower(name), 'readme.') THEN CASE WHEN depth = 1 THEN 9 ELSE 4 END ELSE 0 END
        + CASE WHEN name IN ({_list(L.OVERVIEW_CONFIGS)}) THEN 4 WHEN role = 'config' THEN 2 ELSE 0 END + CASE WHEN name IN ({_list(L.ENTRY_FILES)}) THEN 8 ELSE 0 END
        + CASE WHEN name = '__init__.py' AND depth - CASE WHEN starts_with(path, 'src/') THEN 1 ELSE 0 END <= 4 THEN CASE WHEN list_has_any(string_split(low, '/'), [{_list(L.FRAMEWORK_COMMANDS)}]) THEN 12 WHEN list_has_any(string_split(low, '/'), [{_list(L.FRAMEWORK_ROUTES)}]) THEN 8 ELSE 0 END ELSE 0 END
        + CASE WHEN list_has_any(string_split(low, '/'), [{_list(L.ENTRY_PARTS)}]) THEN 4 ELSE 0 END + CASE WHEN role = 'route' THEN 5 ELSE 0 END - CASE WHEN role IN ('asset', 'migration') THEN 3 ELSE 0 END
        + CASE WHEN script THEN 4 ELSE 0 END + CASE WHEN package THEN 3 ELSE 0 END + CASE WHEN route AND role <> 'test' THEN 3 ELSE 0 END + CASE WHEN entry THEN 7 ELSE 0 END
        + CASE WHEN contains(low, '/src/') OR starts_with(low, 'src/') THEN 1 ELSE 0 END - CASE WHEN contains(low, '/docs/') OR starts_with(low, 'docs/') THEN 2 ELSE 0 END AS s FROM scored LEFT JOIN declared USING (id))"""

_TAGS = f"""tag_rows AS (SELECT id AS file_id, unnest({_useful("path")}) AS tag, 'path' AS source, 1.0 AS weight FROM files
        UNION ALL SELECT id, unnest({_useful("regexp_replace(list_last(string_split(path, '/')), '[.][^.]*$', '')")}), 'filename', 1.3 FROM files
        UNION ALL SELECT id, unnest({_useful("language")}), 'language', 0.6 FROM files UNION ALL SELECT id, unnest({_useful("role")}), 'role', 0.6 FROM files
        UNION ALL SELECT file_id, unnest({_useful("name")}), 'symbol', 1.2 FROM symbols WHERE file_id IN (SELECT id FROM files)
        UNION ALL SELECT file_id, unnest({_useful("kind")}), 'symbol_kind', 0.5 FROM symbols WHERE file_id IN (SELECT id FROM files))"""

_PATH = "'part/1000'"
_RECENT = f"recent AS (SELECT * FROM commits WHERE id IN (SELECT commit_id FROM commit_files WHERE path = {_PATH}) ORDER BY date DESC, id DESC LIMIT 10)"
_SUFFIXES = "suffixes AS (SELECT path, unnest(list_transform(range(1, len(string_split(path, '/')) + 1), lambda i: array_to_string(string_split(path, '/')[i:], '/'))) AS suffix FROM paths), idx AS (SELECT suffix, min(path) AS path FROM suffixes GROUP BY suffix)"


def _plus(sql: str, extra: str, body: str) -> str:
    return sql.rstrip() + (",\n" if sql.strip() else "WITH ") + extra + "\n" + body


_BUDGET = """acted AS (SELECT *, CASE WHEN event = 'noisy' THEN 'skip_unless_needed' WHEN rank % 4 = 0 THEN 'use_memory_context' ELSE 'read' END AS action FROM items),
    counted_up AS (SELECT *, count(*) FILTER (action = 'read') OVER (PARTITION BY plan_id ORDER BY rank) AS run FROM acted),
    budget AS (SELECT plan_id, rank, path, CASE WHEN action = 'skip_unless_needed' THEN action WHEN action = 'read' AND run <= 3 THEN 'read_now' WHEN action = 'read' THEN 'read_if_needed' ELSE 'context_only' END AS read_priority,
        CASE WHEN action = 'read' AND run <= 3 THEN run END AS read_budget_rank FROM counted_up)"""

ORACLE_SQL = {
    "file_language_role": _with(["files"], "SELECT id, path, language, role FROM files"),
    "ignore_filter": _with(
        ["paths"],
        f"""SELECT * FROM (SELECT id, ['.git/', 'vendor/', 'lib/x.egg-info/', 'src/', '.hidden/', ''][id % 6 + 1] || path AS path FROM paths)
        WHERE NOT list_has_any(string_split(path, '/')[:-2], [{_list(L.EXCLUDED_DIRS)}]) AND len(list_filter(string_split(path, '/')[:-2], lambda p: ends_with(p, '.egg-info') OR ends_with(p, '.dist-info') OR (starts_with(p, '.') AND length(p) > 1))) = 0""",
    ),
    "content_fingerprint": "SELECT doc_id AS id, octet_length(encode(text)) AS size, sha256(text) AS sha256 FROM documents",
    "identifier_terms": _with(
        ["paths"],
        f"""SELECT doc_id AS id, array_to_string({_terms("upper(source) || array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') || 'HTTPServer_v2' || 'HTTP2x'")}, ' ') AS terms
        FROM documents JOIN part200 ON doc_id % 200 = name_key""",
    ),
    "query_tokens": _with(["commits"], f"""SELECT id, array_to_string({_distinct(_useful("(message || ' how the apiHandler of go_db')"))}, ' ') AS tokens FROM commits"""),
    "term_stats": "WITH " + _stats("text", "documents", "text") + " SELECT * FROM stats",
    "term_weight_lookup": _plus(_with(["paths"], ""), _stats("path", "paths", "path"), "SELECT token, coalesce(weight, 0.25) AS weight FROM (SELECT unnest(['red', 'widget', 'absentterm']) AS token) LEFT JOIN stats ON term = token"),
    "file_tags": _plus(
        _with(["files", "symbols", "relations"], ""),
        _TAGS + f""", more_tags AS (SELECT * FROM tag_rows UNION ALL SELECT source_id, unnest({_useful("relation")}), 'relation', 0.8 FROM relations WHERE source_id IN (SELECT id FROM files)
            UNION ALL SELECT source_id, unnest({_useful("target_id")}), 'relation_target', 1.0 FROM relations WHERE source_id IN (SELECT id FROM files) AND target_id IS NOT NULL)""",
        "SELECT file_id, tag, source, CAST(max(weight) AS DOUBLE) AS weight FROM more_tags GROUP BY ALL",
    ),
    "keyword_search": _with(
        ["files", "symbols", "commits"],
        """SELECT * FROM (SELECT 'file' AS kind, path AS label, CASE WHEN low = 'widget' THEN 100 ELSE 0 END + CASE WHEN contains(low, 'widget') THEN 40 ELSE 0 END + CASE WHEN role = 'widget' THEN 35 WHEN contains(role, 'widget') THEN 20 ELSE 0 END AS score
          FROM files JOIN named USING (id, path) UNION ALL SELECT DISTINCT 'symbol', name, CASE WHEN lower(name) = 'widget' THEN 90 WHEN contains(lower(name), 'widget') THEN 50 ELSE 0 END FROM symbols
          UNION ALL SELECT DISTINCT 'commit', message, CASE WHEN contains(lower(message), 'widget') THEN 30 ELSE 0 END FROM commits) WHERE score > 0 ORDER BY score DESC, label, kind LIMIT 20""",
    ),
    "context_pack_path_role": _with(["hits"], "SELECT path, CAST(round(score, 6) AS DOUBLE) AS score FROM path_scores"),
    "context_related_symbols": _with(
        ["hits", "symbols"],
        """SELECT name, kind, path, line, score FROM (SELECT symbols.*, files.path, (CASE WHEN files.path IN (SELECT path FROM path_scores ORDER BY score DESC, path LIMIT 10) THEN 1 ELSE 0 END)
            + (CASE WHEN contains(lower(name), 'red') OR contains(lower(name), 'widget') THEN 3 ELSE 0 END) AS score FROM symbols JOIN files ON files.id = file_id) WHERE score > 0 ORDER BY score DESC, path, line, name LIMIT 10""",
    ),
    "feedback_signals": _with(["feedback"], "SELECT * FROM signals"),
    "feedback_explain": _with(
        ["feedback"],
        """, judged AS (SELECT id, path, CASE WHEN path NOT IN (SELECT path FROM paths) THEN 'not-indexed' WHEN similarity < 0.25 THEN 'below-threshold' ELSE 'used' END AS status, round(c, 6) AS contribution FROM weighed WHERE similarity > 0),
        nets AS (SELECT path, round(least(30.0, sum(greatest(contribution, 0.0))) + greatest(-5.0, sum(least(contribution, 0.0))), 6) AS net FROM judged WHERE status = 'used' GROUP BY path)
        SELECT id, path, status, CAST(contribution AS DOUBLE) AS contribution, CASE WHEN status = 'used' THEN CAST(net AS DOUBLE) END AS net, CASE WHEN status = 'used' THEN CAST(row_number() OVER (PARTITION BY path, status ORDER BY abs(contribution) DESC, id) AS INTEGER) END AS place
        FROM judged LEFT JOIN nets USING (path)""",
    ).replace("\n, judged AS", ",\njudged AS"),
    "cochanged_files": _plus(_with(["commits", "commit_files"], ""), _RECENT, f"SELECT path, count(*) AS commits FROM commit_files WHERE commit_id IN (SELECT id FROM recent) AND path <> {_PATH} GROUP BY path ORDER BY commits DESC, path LIMIT 20"),
    "file_recent_commits": _plus(_with(["commits", "commit_files"], ""), _RECENT, "SELECT * FROM recent"),
    "commits_left_join_files": _with(["commits", "commit_files"], "SELECT id, date, count(path) AS n_files FROM commits LEFT JOIN commit_files ON commit_id = id GROUP BY ALL"),
    "callers_of_symbol": _with(
        ["paths"],
        "SELECT path, count(*) AS call_count, min(CAST(json_extract_string(props, '$.k') AS INTEGER)) AS first_line FROM events JOIN paths ON id = user_id WHERE event_type = 'click' GROUP BY path ORDER BY call_count DESC, path LIMIT 50",
    ),
    "symbol_definitions": _with(["paths", "symbols"], "SELECT path, kind, line FROM symbols JOIN paths ON paths.id = file_id WHERE name = 'blue anvil' ORDER BY path, line, kind LIMIT 20"),
    "callers_for_file_symbols": _with(
        ["paths", "symbols"],
        """SELECT symbol_id, name, path, call_count FROM (SELECT symbols.id AS symbol_id, name, path, count(*) AS call_count, row_number() OVER (PARTITION BY symbols.id ORDER BY count(*) DESC, path) AS rank
          FROM events JOIN part200 ON event_id % 200 = name_key JOIN symbols ON name = p_name AND file_id = 7 JOIN paths ON paths.id = user_id WHERE user_id <> 7 GROUP BY symbols.id, name, path) WHERE rank <= 20 ORDER BY call_count DESC, path, symbol_id LIMIT 20""",
    ),
    "relation_dedupe_max_confidence": _with(
        ["relations"],
        "SELECT source_id, relation, target_type, target_id, max(confidence) AS confidence, max_by(metadata, (confidence, metadata)) AS metadata FROM relations WHERE relation NOT IN ('defines', 'calls') GROUP BY ALL",
    ),
    "path_suffix_index": _plus(_with(["paths"], ""), _SUFFIXES, "SELECT suffix, path FROM idx"),
    "edge_resolution": _plus(
        _with(["paths"], ""),
        _SUFFIXES + """, wanted AS (SELECT DISTINCT CASE id % 3 WHEN 0 THEN './' || list_last(string_split(path, '/')) WHEN 1 THEN path ELSE 'x/' || list_last(string_split(path, '/')) END AS target FROM paths)""",
        "SELECT target, coalesce(a.path, b.path) AS path FROM wanted LEFT JOIN idx a ON a.suffix = regexp_replace(target, '^[./]+', '') LEFT JOIN idx b ON b.suffix = list_last(string_split(target, '/'))",
    ),
    "note_staleness": _with(["notes"], "SELECT id, path, stale FROM stale"),
    "note_staleness_dashboard": _with(["notes"], "SELECT id, path, stale_dashboard AS stale FROM stale"),
    "memory_topics": _with(
        ["notes"],
        """SELECT topic, count(*) AS note_count, CAST(count(DISTINCT path) AS INTEGER) AS file_count, count(*) FILTER (scope = 'repo') AS repo_count, count(*) FILTER (stale) AS stale_count, max(id) AS latest_id, arg_max(created_at, id) AS latest_created_at, array_to_string(list_sort(list_distinct(list(path)))[:10], ',') AS paths,
            array_to_string(list_reverse_sort(list(id))[:5], ',') AS newest FROM stale GROUP BY topic ORDER BY note_count DESC, topic LIMIT 20""",
    ),
    "memory_audit": _with(
        ["notes"],
        f"""SELECT id, 'stale' AS issue FROM stale WHERE stale UNION ALL SELECT id, 'short_note' FROM stale WHERE len(list_distinct({_useful("note")})) < 5 UNION ALL SELECT id, 'no_hash' FROM stale WHERE scope = 'file' AND file_sha256 = ''""",
    ),
    "duplicate_topics": _with(["notes"], "SELECT path, topic, count(*) AS notes, max(id) AS latest_id, array_to_string(list_reverse_sort(list(id))[:20], ',') AS ids FROM notes WHERE scope = 'file' GROUP BY path, topic HAVING count(*) > 1"),
    "file_activity": _with(
        ["notes", "feedback", "items"],
        """SELECT path, count(*) FILTER (k = 'n') AS notes, count(*) FILTER (k = 'f') AS feedback, count(*) FILTER (k = 'e') AS events, count(*) AS total FROM (SELECT path, 'n' AS k FROM notes UNION ALL SELECT path, 'f' FROM feedback UNION ALL SELECT path, 'e' FROM items) GROUP BY path""",
    ),
    "subsystem_rollup": _with(
        ["files"],
        """SELECT prefix, CAST(sum(n) FILTER (what = 'language') AS BIGINT) AS files, string_agg(label, ',' ORDER BY rank) FILTER (rank <= 3 AND what = 'language') AS languages, string_agg(label, ',' ORDER BY rank) FILTER (rank <= 3 AND what = 'role') AS roles
        FROM (SELECT prefix, what, label, count(*) AS n, row_number() OVER (PARTITION BY prefix, what ORDER BY count(*) DESC, min(path)) AS rank
          FROM (SELECT string_split(path, '/')[1] AS prefix, path, 'language' AS what, language AS label FROM files UNION ALL SELECT string_split(path, '/')[1], path, 'role', role FROM files) GROUP BY prefix, what, label) GROUP BY prefix ORDER BY files DESC, prefix LIMIT 10""",
    ),
    "overview_first_reads": _plus(_with(["project"], ""), _FIRST_READS, "SELECT path, score FROM (SELECT path, depth, CAST(CASE WHEN role = 'test' THEN s * 0.2 ELSE s END AS DOUBLE) AS score FROM points) WHERE score > 0 ORDER BY score DESC, depth, path LIMIT 12"),
    "estimate_tokens": _with(["content"], "SELECT language, count(*) AS files, CAST(sum(length(content)) AS BIGINT) AS characters, CAST(ceil(sum(length(content)) / 4) AS BIGINT) AS tokens FROM content GROUP BY language"),
    "refresh_diff": _with(
        ["before"],
        "SELECT coalesce(o.path, n.path) AS path, CASE WHEN o.sha256 IS NULL THEN 'added' WHEN n.sha256 IS NULL THEN 'removed' WHEN o.sha256 = n.sha256 THEN 'unchanged' ELSE 'updated' END AS change FROM old o FULL JOIN content n ON o.path = n.path",
    ),
    "doctor_diff": _with(
        ["before"],
        "SELECT path, 'missing_on_disk' AS issue FROM old WHERE path NOT IN (SELECT path FROM paths) UNION ALL SELECT path, 'not_indexed' FROM paths WHERE path NOT IN (SELECT path FROM old)",
    ),
    "task_merge": """WITH o AS (SELECT l_orderkey AS id, list(DISTINCT CAST(l_partkey AS VARCHAR)) AS f FROM lineitem WHERE l_linenumber <= 2 GROUP BY 1), n AS (SELECT l_orderkey AS id, list(DISTINCT CAST(l_partkey AS VARCHAR)) AS g FROM lineitem WHERE l_linenumber > 1 GROUP BY 1),
        m AS (SELECT id, list_distinct(list_concat(f, coalesce(g, []))) AS files FROM o LEFT JOIN n USING (id)) SELECT id, CAST(len(files) AS INTEGER) AS n_files, array_to_string(list_sort(files), ',') AS files FROM m""",
    "plan_diff": _plus(
        _with(["items"], ""), _BUDGET
        + """, said AS (SELECT plan_id, path, 'opened' AS event FROM items WHERE rank % 2 = 1 UNION ALL SELECT plan_id, path, event FROM items WHERE event = 'useful' AND rank % 3 = 1 UNION ALL SELECT plan_id, 'extra/' || path, 'read' FROM items WHERE rank = 1),
        seen AS (SELECT plan_id, path, bool_or(event IN ('opened', 'read')) AS was_read, bool_or(event = 'useful') AS judged FROM said GROUP BY ALL),
        joint AS (SELECT plan_id, path, b.path IS NOT NULL AS planned, coalesce(read_priority = 'read_now', false) AS now, coalesce(was_read, false) AS was_read, coalesce(judged, false) AS judged FROM budget b FULL JOIN seen USING (plan_id, path))""",
        """SELECT plan_id, path, 'suggested_not_read' AS difference FROM joint WHERE planned AND NOT was_read UNION ALL SELECT plan_id, path, 'read_not_planned' FROM joint WHERE was_read AND NOT planned
        UNION ALL SELECT plan_id, path, 'read_now_not_read' FROM joint WHERE now AND NOT was_read UNION ALL SELECT plan_id, path, 'read_without_outcome' FROM joint WHERE was_read AND NOT judged""",
    ),
    "plan_stats": _with(
        ["items"],
        """SELECT plans, finished, plans - finished AS unfinished, CAST(3 AS DOUBLE) AS average_budget, round(opened / finished, 4) AS opened_per_plan, round(top1 / finished, 4) AS top1_rate, round(top3 / finished, 4) AS top3_rate, missing
        FROM (SELECT count(*) AS plans, count(*) FILTER (o_orderstatus <> 'O') AS finished FROM orders),
             (SELECT count(*) FILTER (event = 'opened') AS opened FROM items WHERE plan_id IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'O')),
             (SELECT count(DISTINCT CASE WHEN event = 'useful' AND rank <= 1 THEN plan_id END) AS top1, count(DISTINCT CASE WHEN event = 'useful' AND rank <= 3 THEN plan_id END) AS top3, count(*) FILTER (event = 'missing') AS missing FROM items)""",
    ),
    "plan_histogram": _with(["items"], "SELECT CAST(rank AS INTEGER) AS rank, count(*) FILTER (event = 'useful') AS useful, count(*) FILTER (event = 'noisy') AS noisy FROM items WHERE event IN ('useful', 'noisy') GROUP BY rank"),
    "reading_plan_budget": _plus(_with(["items"], ""), _BUDGET, "SELECT plan_id, CAST(rank AS INTEGER) AS rank, path, read_priority, read_budget_rank FROM budget"),
    "retrieval_eval": _with(
        ["feedback"],
        """, cases AS (SELECT query AS name, list_sort(list_distinct(list(path)))[:3] AS expected FROM feedback WHERE rating = 'useful' GROUP BY query),
        parts AS (SELECT path, unnest(list_distinct(list_filter(regexp_extract_all(lower(path), '[a-z]+|[0-9]+'), lambda t: length(t) >= 3))) AS token, regexp_extract_all(lower(list_last(string_split(path, '/'))), '[a-z]+|[0-9]+') AS n FROM paths),
        asked AS (SELECT name, unnest(list_distinct(string_split(name, ' '))) AS token FROM cases),
        placed AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY score DESC, path) AS rank FROM (SELECT name, path, sum(7 + CASE WHEN list_contains(n, token) THEN 5 ELSE 0 END) AS score FROM parts JOIN asked USING (token) GROUP BY name, path)),
        lists AS (SELECT name, list(path ORDER BY rank) AS c FROM placed WHERE rank <= 10 GROUP BY name), j AS (SELECT cases.*, coalesce(c, []) AS c FROM cases LEFT JOIN lists USING (name))
        SELECT name, 'ok' AS status, list_has_any(c[:1], expected) AS top1_hit, list_has_any(c[:3], expected) AS top3_hit, list_has_any(c[:5], expected) AS top5_hit, CAST(len(expected) AS INTEGER) AS expected_count,
            CAST(len(list_intersect(expected, c)) AS INTEGER) AS expected_hit_count, CAST(len(expected) - len(list_intersect(expected, c)) AS INTEGER) AS missing_expected_count,
            CAST(len(list_filter(c, lambda p: contains(p, 'tests/') OR contains(p, '.css'))) AS INTEGER) AS noise_hit_count, CAST(len(c) AS INTEGER) AS candidate_file_count,
            array_to_string(list_transform(expected, lambda p: p || '=' || CASE WHEN list_contains(c, p) THEN CAST(list_position(c, p) AS VARCHAR) ELSE 'missing' END), '; ') AS expected_file_ranks,
            array_to_string(list_filter(expected, lambda p: NOT list_contains(c, p)), '; ') AS missing_expected_files FROM j""",
    ).replace("\n, cases AS", ",\ncases AS"),
    "savings": _with(
        ["content"],
        """SELECT language, round(greatest(0.0, (1 - r / a) * 100), 1) AS saved, round(greatest(a - r, 0) / a * 100, 1) AS reduction FROM (SELECT language, CAST(sum(length(content)) AS DOUBLE) AS a, CAST(sum(CASE WHEN id % 10 = 0 THEN length(content) ELSE 0 END) AS DOUBLE) AS r FROM content GROUP BY language)""",
    ),
    "session_events": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS events FROM events GROUP BY ALL",
}

_TRACE = ("widget", "test", "product")


def _bias(role: str, low: str) -> str:
    """For tokens that want tests and no documentation."""
    return f"""CASE WHEN {role} = 'test' THEN 2.0 ELSE 0.0 END - CASE WHEN {role} = 'documentation' OR regexp_matches({low}, '[.](md|rst)$') THEN 3.0 ELSE 0.0 END
        - CASE WHEN contains({low}, '/versions/') OR starts_with({low}, 'alembic/') OR contains({low}, '/migrations/') THEN 3.0 ELSE 0.0 END - CASE WHEN regexp_matches({low}, '[.](css|png|jpg|jpeg|gif|webp|svg)$') THEN 4.0 ELSE 0.0 END"""


_ALL_STATS = f"""texts AS (SELECT 'path' AS source, path AS t FROM files UNION ALL SELECT 'filename', list_last(string_split(path, '/')) FROM files UNION ALL SELECT 'language', language FROM files UNION ALL SELECT 'role', role FROM files
        UNION ALL SELECT 'symbol', name FROM symbols UNION ALL SELECT 'commit', message FROM commits), texts2 AS (SELECT row_number() OVER () AS r, source, t FROM texts),
    words AS (SELECT r, source, unnest({_useful("t")}) AS term FROM texts2), counted AS (SELECT term, source, count(DISTINCT r) AS dc, count(*) AS tc FROM words GROUP BY ALL),
    sized AS (SELECT source, count(*) AS n FROM texts GROUP BY source UNION ALL SELECT 'all', count(*) FROM texts),
    all_stats AS (SELECT term, source, CAST(dc AS BIGINT) AS document_count, CAST(tc AS BIGINT) AS total_count, least(2.8, greatest(0.25, 0.45 + ln((n + 1) / (dc + 1)))) AS weight
        FROM (SELECT * FROM counted UNION ALL SELECT term, 'all', sum(dc), sum(tc) FROM counted GROUP BY term) JOIN sized USING (source))"""


def _soft(terms: str) -> str:
    """Best prefix or inside match of ``token`` with a term; sequence similarity
    adds nothing to the tokens and terms of the test tables."""
    return f"""coalesce(CASE WHEN length(token) >= 6 THEN list_max(list_transform(list_filter({terms}, lambda c: length(c) >= 5), lambda c: CASE WHEN least(length(c), length(token)) < 6 THEN 0.0
        WHEN least(length(c), length(token)) / greatest(length(c), length(token)) >= 0.5 AND (starts_with(c, token) OR starts_with(token, c)) THEN 0.9
        WHEN least(length(c), length(token)) / greatest(length(c), length(token)) >= 0.65 AND (contains(c, token) OR contains(token, c)) THEN 0.84 ELSE 0.0 END)) END, 0.0)"""


_STEP = "regexp_replace(target_id, '^[./]+', '')"
_RELATED = f"""csuf AS (SELECT path, unnest(list_transform(range(1, len(string_split(path, '/')) + 1), lambda i: array_to_string(string_split(path, '/')[i:], '/'))) AS suffix FROM path_scores), cidx AS (SELECT suffix, min(path) AS path FROM csuf GROUP BY suffix),
    linked AS (SELECT f.path AS source, coalesce(a.path, b.path) AS linked, f.path IN (SELECT path FROM path_scores) AS inside FROM relations JOIN paths f ON f.id = source_id
        LEFT JOIN cidx a ON a.suffix = {_STEP} LEFT JOIN cidx b ON b.suffix = list_last(string_split({_STEP}, '/')))"""
_TAGGED = "tagged AS (SELECT *, CASE WHEN id % 2 = 1 THEN [topic, 'Widget'] ELSE [topic] END AS tags FROM stale)"
_ENTRIES = f"""picked AS (SELECT path, psymbols.name, kind, line, 0 AS late FROM psymbols JOIN project ON project.id = file_id WHERE (kind IN ('project_script', 'package_script', 'route') OR lower(psymbols.name) IN ({_list(L.ENTRY_NAMES)}) OR ends_with(lower(psymbols.name), 'app')) AND NOT (role = 'test' AND kind = 'route')
        UNION ALL SELECT path, name, 'file', 0, 1 FROM project WHERE name IN ({_list(L.ENTRY_FILES)}) OR (name = '__init__.py' AND depth - CASE WHEN starts_with(path, 'src/') THEN 1 ELSE 0 END <= 4 AND list_has_any(string_split(path, '/'), [{_list(L.FRAMEWORK_PARTS)}]))),
    once AS (SELECT path, kind, name, min(late) AS late, min(line) AS line FROM picked GROUP BY ALL),
    judged AS (SELECT once.*, depth, CASE WHEN kind = 'project_script' THEN 0 WHEN project.name IN ({_list(L.ENTRY_FILES)}) THEN 1 WHEN project.name = '__init__.py' AND depth - CASE WHEN starts_with(path, 'src/') THEN 1 ELSE 0 END <= 4 AND list_has_any(string_split(path, '/'), [{_list(L.FRAMEWORK_PARTS)}]) THEN 2
        WHEN kind = 'route' THEN 3 WHEN kind = 'package_script' THEN 4 ELSE 5 END AS priority FROM once JOIN project USING (path))"""
_GONE = "gone AS (SELECT id, path FROM files WHERE id % 5 = 0), tags AS (SELECT DISTINCT file_id, source, tag FROM tag_rows)"

ORACLE_SQL |= {
    "term_stats_all": _plus(
        _with(["files", "symbols", "commits"], ""), _ALL_STATS,
        "SELECT term, source, document_count, total_count, round(weight, 6) AS weight FROM all_stats",
    ),
    "context_pack_full": _plus(
        _with(["hits", "symbols", "commits", "commit_files", "relations", "feedback"], "").replace("['red', 'widget']", "['red', 'widget', 'sprockets']"),
        _ALL_STATS
        + f""", token_stats AS (SELECT token, count(term) AS known, {", ".join(f"max(CASE WHEN source = '{x}' THEN weight END) AS w_{x}" for x in ("all", "path", "filename", "language", "role", "symbol", "commit"))}
            FROM lookup LEFT JOIN (SELECT term, source, round(weight, 6) AS weight FROM all_stats) ON term = token GROUP BY token),
        worth AS (SELECT token, {", ".join(f"CASE WHEN known = 0 THEN 0.25 ELSE coalesce(w_{x}, w_all, 1.0) END AS {x}" for x in ("path", "filename", "language", "role", "symbol", "commit"))} FROM token_stats),
        worded AS (SELECT id, path, role, language, name, regexp_extract_all(lower(path), '[a-z]+|[0-9]+') AS pt, regexp_extract_all(lower(name), '[a-z]+|[0-9]+') AS nt FROM prepared),
        soft AS (SELECT id, w.*, {_soft("pt")} AS sp, {_soft("nt")} AS sn, list_contains(pt, token) AS ep, list_contains(nt, token) AS en, contains(worded.role, token) OR contains(worded.language, token) AS labelled,
            length(token) >= 5 AND contains(regexp_replace(lower(regexp_replace(name, '[.][^.]*$', '')), '[^a-z0-9]', '', 'g'), token) AS inside, worded.path AS file FROM worded, worth w),
        points AS (SELECT file AS path, CAST(CASE WHEN ep THEN 7 * path ELSE 2.5 * path * sp END + CASE WHEN en THEN 5 * filename WHEN inside THEN 4 * filename ELSE 0 END + CASE WHEN en THEN 0 ELSE 2.0 * filename * sn END
                + CASE WHEN labelled THEN 1.5 * greatest(role, language) ELSE 0 END AS DOUBLE) AS score FROM soft
            UNION ALL SELECT files.path, 3.5 * symbol * CASE WHEN files.role = 'documentation' THEN CASE WHEN kind IN ('heading', 'command_example') THEN 0.25 ELSE 0.5 END ELSE 1.0 END
                FROM (SELECT file_id, token, arg_min(kind, id) AS kind FROM symbols, lookup WHERE contains(lower(name), token) GROUP BY ALL) JOIN files ON files.id = file_id JOIN worth USING (token)
            UNION ALL SELECT path, amount FROM commit_files JOIN (SELECT commits.id, 0.8 + sum(1.2 * worth.commit) AS amount FROM commits, worth WHERE contains(lower(message), token) GROUP BY commits.id) c ON c.id = commit_id
            UNION ALL SELECT path, 2.2 * symbol FROM (SELECT DISTINCT paths.path, token FROM relations JOIN paths ON paths.id = source_id, lookup WHERE relation = 'calls' AND contains(lower(target_id), token)) JOIN (SELECT token, symbol FROM worth) USING (token)),
        totals AS (SELECT path, sum(score) AS score FROM points WHERE score > 0 GROUP BY path), """
        + _RELATED.replace("path_scores", "(SELECT path FROM totals WHERE score > 0)")
        + """, joint AS (SELECT path, sum(score) AS score FROM (SELECT * FROM totals UNION ALL SELECT path, CAST(least(0.5 * count(*), 1.5) AS DOUBLE) FROM (SELECT linked AS path FROM linked WHERE inside AND linked <> source UNION ALL SELECT source FROM linked WHERE NOT inside AND linked IS NOT NULL) GROUP BY path) GROUP BY path),
        judged AS (SELECT path, language, role, (score * CASE WHEN role = 'test' THEN 0.45 ELSE 1.0 END * CASE WHEN role = 'asset' OR ext IN ('.css', '.scss', '.less') THEN 0.7 ELSE 1.0 END * CASE WHEN role = 'migration' OR ext = '.sql' THEN 0.75 ELSE 1.0 END
            * CASE WHEN role = 'documentation' OR ext IN ('.md', '.rst', '.txt') THEN 0.4 ELSE 1.0 END) AS s, role = 'source' AND ext IN ('.php', '.py', '.js', '.ts', '.go', '.rs') AS code FROM joint JOIN files USING (path) JOIN named USING (path)),
        boosted AS (SELECT path, language, role, CASE WHEN code THEN s * 1.05 + 0.1 ELSE s END + coalesce(boost, 0) AS b, coalesce(penalty, 0) AS p FROM judged LEFT JOIN signals USING (path)),
        best AS (SELECT path, language, role, CAST(round(CASE WHEN p < 0 AND b > 0 THEN greatest(0.0, b + p) * 0.35 ELSE b END, 6) AS DOUBLE) AS raw FROM boosted ORDER BY raw DESC, path LIMIT 10)""",
        "SELECT path, language, role, raw, round_even(raw / (SELECT max(raw) FROM best), 2) AS score FROM best WHERE raw > 0",
    ),
    "memory_search": _plus(
        _with(["notes"], ""), _TAGGED,
        f"""SELECT id, score FROM (SELECT id, CAST(round(len(list_intersect(['user', 'widget'], {_useful("concat_ws(' ', path, topic, note, array_to_string(tags, ' '))")})) / 2 + CASE WHEN contains(lower(topic), 'user widget') THEN 0.5 ELSE 0.0 END
            + CASE WHEN contains(lower(path), 'user') OR contains(lower(path), 'widget') THEN 0.2 ELSE 0.0 END + CASE WHEN list_has_any(['user', 'widget'], tags) THEN 0.4 ELSE 0.0 END, 4) AS DOUBLE) AS score FROM tagged) WHERE score > 0 ORDER BY score DESC, id DESC LIMIT 10""",
    ),
    "context_calls": _with(
        ["relations"],
        """SELECT path, round(sum(2.2), 6)::DOUBLE AS score FROM (SELECT DISTINCT path, token FROM relations JOIN paths ON paths.id = source_id, (SELECT unnest(['red', 'widget']) AS token) WHERE relation = 'calls' AND contains(lower(target_id), token)) GROUP BY path""",
    ),
    "context_related_files": _plus(
        _with(["hits", "relations"], ""), _RELATED,
        "SELECT path, CAST(least(0.5 * count(*), 1.5) AS DOUBLE) AS score FROM (SELECT linked AS path FROM linked WHERE inside AND linked <> source UNION ALL SELECT source FROM linked WHERE NOT inside AND linked IS NOT NULL) GROUP BY path",
    ),
    "context_commits": _plus(
        _with(["hits", "commits", "commit_files"], ""),
        """touched AS (SELECT commits.id, date, message, list_distinct(list(commit_files.path) FILTER (commit_files.path IS NOT NULL)) AS f, count(path_scores.path) AS hit FROM commits LEFT JOIN commit_files ON commit_id = commits.id LEFT JOIN path_scores USING (path)
        WHERE contains(lower(message), 'red') OR contains(lower(message), 'widget') GROUP BY ALL)""",
        "SELECT id, date, message, array_to_string(list_sort(coalesce(f, []))[:10], ',') AS files, CAST(len(coalesce(f, [])) AS BIGINT) AS total_files, len(coalesce(f, [])) > 10 AS files_truncated FROM touched WHERE hit > 0 OR len(coalesce(f, [])) = 0 ORDER BY date DESC, id DESC LIMIT 5",
    ),
    "resolved_calls": _plus(
        _with(["files", "symbols", "relations"], ""),
        """called AS (SELECT target_id AS name, max(confidence) AS confidence FROM relations WHERE source_id = 9 AND relation = 'calls' GROUP BY target_id),
        defs AS (SELECT symbols.name, path, kind, line, row_number() OVER (PARTITION BY symbols.name ORDER BY path, line, kind, symbols.id) AS rank FROM symbols JOIN files ON files.id = file_id WHERE kind IN ('function', 'method') AND (language = 'php' OR (SELECT language FROM files WHERE id = 9) <> 'php'))""",
        "SELECT name, confidence, path, kind, line FROM called LEFT JOIN (SELECT * FROM defs WHERE rank <= 10) USING (name)",
    ),
    "export_relations": _with(
        ["symbols", "relations"],
        """SELECT r.id, f.path AS source_path, relation, target_type, target_id, CASE WHEN target_type = 'file' THEN target_id END AS target_path, s.name AS target_symbol, s.kind AS target_kind, s.line AS target_line, confidence, metadata
        FROM relations r LEFT JOIN paths f ON f.id = source_id LEFT JOIN symbols s ON target_type = 'symbol' AND s.id = TRY_CAST(target_id AS BIGINT)""",
    ),
    "export_commits": _with(
        ["commits", "commit_files"],
        "SELECT id, date, message, coalesce(string_agg(path, ',' ORDER BY path), '') AS files FROM commits LEFT JOIN (SELECT DISTINCT commit_id, path FROM commit_files) ON commit_id = id GROUP BY ALL",
    ),
    "upsert_files": _with(
        ["content"],
        """SELECT id, path, language, CASE WHEN id % 3 = 0 THEN 'altered' ELSE sha256 END AS sha256 FROM content
        UNION ALL SELECT (SELECT max(id) FROM content) + row_number() OVER (ORDER BY substr(md5('new/' || path), 1, 3), path), 'new/' || path, language, sha256 FROM content WHERE id % 7 = 0""",
    ),
    "append_notes": _plus(
        _with(["notes"], ""),
        "more AS (SELECT path, concat_ws(' ', 'again', id, note) AS note FROM notes WHERE id % 2 = 1)",
        "SELECT id, path, note FROM notes UNION ALL SELECT (SELECT max(id) FROM notes) + row_number() OVER (ORDER BY substr(md5(note), 1, 3), note), path, note FROM more",
    ),
    "replace_symbols": _with(
        ["symbols"],
        "SELECT id, file_id, name, kind, line FROM symbols WHERE file_id % 4 >= 2 UNION ALL SELECT id, file_id, name, 'function', line FROM symbols WHERE file_id % 4 = 0 AND line % 2 = 0",
    ),
    "defines_edges": _with(
        ["symbols"],
        """SELECT file_id AS source_id, 'defines' AS relation, 'symbol' AS target_type, CAST(id AS VARCHAR) AS target_id, CAST(1 AS DOUBLE) AS confidence, '{"kind":"' || kind || '","line":' || line || ',"name":"' || name || '"}' AS metadata FROM symbols""",
    ),
    "cascade_delete": _plus(
        _plus(_with(["files", "symbols", "relations"], ""), _TAGS, ""), _GONE,
        """SELECT 'files' AS section, CAST(id AS VARCHAR) AS row FROM files WHERE id % 5 <> 0 UNION ALL SELECT 'symbols', CAST(id AS VARCHAR) FROM symbols WHERE file_id NOT IN (SELECT id FROM gone)
        UNION ALL SELECT 'file_tags', file_id || '/' || source || '/' || tag FROM tags WHERE file_id NOT IN (SELECT id FROM gone)
        UNION ALL SELECT 'relations', CAST(id AS VARCHAR) FROM relations WHERE source_id NOT IN (SELECT id FROM gone) AND NOT (target_type = 'file' AND target_id IS NOT NULL AND target_id IN (SELECT path FROM gone))
            AND NOT (target_type = 'symbol' AND target_id IN (SELECT CAST(id AS VARCHAR) FROM symbols WHERE file_id IN (SELECT id FROM gone)))""",
    ),
    "upsert_meta": "SELECT upper(n_name) AS key, CASE WHEN n_nationkey % 2 = 0 THEN CAST(n_nationkey AS VARCHAR) ELSE 'old' END AS value FROM nation UNION ALL SELECT upper(r_name), CAST(r_regionkey AS VARCHAR) FROM region",
    "update_notes": _with(
        ["notes"],
        """SELECT notes.id, CASE WHEN notes.id % 3 = 0 THEN 'moved' ELSE topic END AS topic, CASE WHEN notes.id % 6 = 0 THEN 'new ApiHandler text' ELSE note END AS note, CASE WHEN notes.id % 3 = 0 THEN CASE WHEN scope = 'file' THEN sha256 END ELSE file_sha256 END AS file_sha256,
        CASE WHEN notes.id % 3 = 0 THEN '2025-01-01' ELSE '2024-01-01' END AS created_at, notes.id % 3 = 0 AS tokenised FROM notes LEFT JOIN content USING (path)""",
    ),
    "delete_notes": _with(["notes"], "SELECT id, path FROM notes WHERE id NOT IN (1000, 2001, 3000)"),
    "clear_feedback": _with(["feedback"], "SELECT id, path, query FROM feedback WHERE query <> 'red widget'"),
    "flow_topics": _plus(
        _plus(_with(["files", "symbols", "notes"], ""), _TAGS, ""),
        _TAGGED
        + """, newest AS (SELECT * FROM tagged ORDER BY id DESC LIMIT 100), n AS (SELECT path, scope, stale, lower(unnest(tags)) AS tag, id FROM newest), n2 AS (SELECT *, row_number() OVER (PARTITION BY tag ORDER BY id DESC) AS place FROM n),
        ft AS (SELECT DISTINCT file_id, source, tag FROM tag_rows), rows AS (SELECT tag, path, 1 AS note, (coalesce(stale, false))::int AS stale, 0 AS ft, scope = 'repo' AND place <= 5 AS repo FROM n2 UNION ALL SELECT lower(tag), path, 0, 0, 1, false FROM ft JOIN files ON files.id = file_id)""",
        """SELECT tag, count(DISTINCT path) AS file_count, CAST(sum(note) AS BIGINT) AS note_count, CAST(sum(stale) AS BIGINT) AS stale_count, CAST(sum(ft) AS BIGINT) AS file_tag_count, CAST(sum(note) AS BIGINT) AS memory_tag_count, count(DISTINCT path) >= 3 AND NOT bool_or(repo) AS needs_summary
        FROM rows GROUP BY tag ORDER BY note_count DESC, file_count DESC, tag LIMIT 20""",
    ),
    "plan_activity": _plus(
        _with(["items"], ""),
        "r AS (SELECT o_orderkey AS id, o_orderstatus <> 'O' AS finished FROM orders ORDER BY id DESC LIMIT 20)",
        """SELECT * FROM (SELECT count(*) AS recent_plans, count(*) FILTER (NOT finished) AS unfinished_plans, count(*) FILTER (finished) AS finished_plans FROM r),
        (SELECT count(*) AS event_count, count(*) FILTER (event = 'opened') AS read_count, CAST(0 AS BIGINT) AS verified_count, count(*) FILTER (event = 'useful') AS useful_count, count(*) FILTER (event = 'noisy') AS noisy_count, CAST(0 AS BIGINT) AS missing_count FROM items WHERE plan_id IN (SELECT id FROM r))""",
    ),
    "benchmark_summary": """WITH r AS (SELECT doc_id AS k, quality = 1 AS t1, quality = 1 OR doc_id % 2 = 0 AS t3, doc_id % 9 <> 0 AS t5, toxic FROM labels WHERE doc_id % 10 <> 0)
        SELECT count(*) AS cases, count(*) FILTER (t1) AS top1_hits, count(*) FILTER (t3) AS top3_hits, count(*) FILTER (t5) AS top5_hits, round(count(*) FILTER (t1) / count(*), 3) AS top1_rate, round(count(*) FILTER (t3) / count(*), 3) AS top3_rate, round(count(*) FILTER (t5) / count(*), 3) AS top5_rate,
        CAST(sum(toxic) AS BIGINT) AS noise_hits, round(avg(CAST(k % 7 AS DOUBLE) * 0.25), 3) AS average_elapsed_seconds, round(avg(CAST(k % 100 AS DOUBLE) * 0.5) FILTER (k % 4 <> 0), 1) AS average_manual_scan_reduction_percent, round(avg(CAST(k % 5 AS DOUBLE) * 0.125) FILTER (k % 3 = 0), 3) AS average_manual_scan_elapsed_seconds FROM r""",
    "overview_entry_points": _plus(_with(["project"], ""), _ENTRIES, "SELECT path, name, kind, line FROM judged ORDER BY priority, depth, path, late, line, name, kind LIMIT 10"),
    "overview_manifests": _plus(
        _with(["project"], ""),
        f"""top AS (SELECT id, path, language, role FROM project WHERE name IN ({_list(L.MANIFESTS)}) OR starts_with(lower(name), 'readme.') OR role = 'config' ORDER BY CASE WHEN name = 'pyproject.toml' THEN 0 WHEN starts_with(lower(name), 'readme.') THEN 1 ELSE 2 END, depth, path LIMIT 10),
        own AS (SELECT file_id, kind || ':' || name AS label, row_number() OVER (PARTITION BY file_id ORDER BY line, name, kind) AS rank FROM psymbols)""",
        "SELECT path, language, role, string_agg(label, ',' ORDER BY rank) AS symbols FROM top JOIN own ON file_id = id WHERE rank <= 5 GROUP BY ALL",
    ),
    "trace_starts": _plus(
        _with(["content", "project"], ""),
        f"""queried AS (SELECT id, path, CASE WHEN contains(lower(path), 'test') THEN 4.0 ELSE 0.0 END + CASE WHEN contains(lower(content), 'test') THEN 2.0 ELSE 0.0 END + {_bias("role", "lower(path)")} AS score FROM content),
        first4 AS (SELECT id, path, 0 AS part, -score AS a, id AS b FROM queried WHERE score <> 0 ORDER BY score DESC, id LIMIT 4),
        told AS (SELECT content.id, path, name, kind, min(line) AS line, CASE kind WHEN 'project_script' THEN 0 WHEN 'route' THEN 3 WHEN 'package_script' THEN 4 ELSE 5 END AS priority FROM psymbols JOIN content ON content.id = file_id
            WHERE (kind <> 'function' OR lower(name) IN ({_list(L.ENTRY_NAMES)}) OR ends_with(lower(name), 'app')) AND NOT (role = 'test' AND kind = 'route') GROUP BY ALL),
        entries AS (SELECT id, path, row_number() OVER (ORDER BY priority, len(string_split(path, '/')), path, line, name, kind) AS pos FROM told),
        each AS (SELECT id, path, min((part, a, b)) AS spot FROM (SELECT id, path, part, CAST(a AS DOUBLE) AS a, CAST(b AS DOUBLE) AS b FROM first4 UNION ALL SELECT id, path, 1, CAST(pos AS DOUBLE), CAST(0 AS DOUBLE) FROM entries WHERE pos <= 4) GROUP BY id, path)""",
        "SELECT * FROM (SELECT id, path, CAST(row_number() OVER (ORDER BY spot) AS INTEGER) AS place FROM each) WHERE place <= 8",
    ),
    "trace_scores": _with(
        ["content"],
        f"""SELECT path, CAST(round(greatest(0.0, greatest(0.1, 3.0 - (id % 12) * 0.35) + {" + ".join(f"CASE WHEN contains(low, '{t}') THEN 4.0 ELSE 0.0 END + CASE WHEN contains(body, '{t}') THEN 2.0 WHEN contains(base, '{t}') THEN 1.5 ELSE 0.0 END" for t in _TRACE)}
          + {_bias("CASE WHEN contains(low, '/test') OR starts_with(low, 'test') THEN 'test' ELSE '' END", "low")} + CASE WHEN {" OR ".join(f"contains(low, '{p}')" for p in L.SERVICE_PARTS)} THEN 1.0 ELSE 0.0 END
          + CASE WHEN regexp_matches(body, '\\b(handle|process|dispatch|orchestrat|route|persist|create)_?[a-z_]*\\b') THEN 0.75 ELSE 0.0 END + CASE WHEN regexp_matches(body, '<h[1-6]\\b|echo\\s+[''"]<|<main\\b|<title\\b|render\\(|template') THEN 2.0 ELSE 0.0 END), 6) AS DOUBLE) AS score
        FROM (SELECT id, path, lower(path) AS low, coalesce(lower(content), '') AS body, list_last(string_split(lower(path), '/')) AS base FROM content)""",
    ),
    "trace_profile": "SELECT o_orderkey AS id, CASE o_orderkey % 3 WHEN 0 THEN 'entrypoint_render' WHEN 1 THEN 'test_trace' ELSE 'entrypoint_trace' END AS profile FROM orders",
}

_TAG_SCORE = "best AS (SELECT file_id, tag, source, max(weight) AS weight FROM tag_rows GROUP BY ALL)"

ORACLE_SQL |= {
    "list_feedback": _with(["feedback"], "SELECT id, path, rating FROM feedback WHERE query = 'red widget'"),
    "list_notes": _with(["notes"], "SELECT id, path, topic FROM stale WHERE scope = 'file' ORDER BY id DESC LIMIT 100"),
    "list_stale_notes": _with(["notes"], "SELECT id, path, stale FROM (SELECT * FROM stale ORDER BY id DESC LIMIT 500) WHERE scope = 'file' AND coalesce(stale, true) ORDER BY id DESC LIMIT 50"),
    "list_tasks": "SELECT o_orderkey AS id, 'open' AS status, o_orderpriority AS topic, strftime(o_orderdate, '%Y-%m-%d') AS updated_at FROM orders WHERE o_orderstatus <> 'F' AND o_orderpriority = '1-URGENT' ORDER BY updated_at DESC, id DESC LIMIT 20",
    "list_plans": _plus(
        _with(["items"], ""),
        "top AS (SELECT o_orderkey AS id, false AS finished FROM orders WHERE o_orderstatus = 'O' ORDER BY id DESC LIMIT 20)",
        "SELECT id, finished, coalesce(string_agg(path, ',' ORDER BY rank) FILTER (rank <= 2), '') AS items, coalesce(string_agg(path || '=' || event, ',' ORDER BY rank) FILTER (event <> 'opened'), '') AS events FROM top LEFT JOIN items ON plan_id = id GROUP BY id, finished",
    ),
    "focused_entry_points": _plus(_with(["project"], ""), _ENTRIES, "SELECT * FROM (SELECT path, name, kind, line FROM judged ORDER BY priority, depth, path, late, line, name, kind LIMIT 10) WHERE kind NOT IN ('heading', 'command_example') AND NOT ends_with(path, '.md')"),
    "supporting_files": _with(["hits"], "SELECT path, CAST(round(score, 6) AS DOUBLE) AS score FROM path_scores WHERE path NOT IN (SELECT path FROM files ORDER BY path LIMIT 4) ORDER BY score DESC, path LIMIT 6"),
    "table_counts": _with(
        ["symbols", "relations", "commits"],
        "SELECT 'files' AS name, count(*) AS rows FROM paths UNION ALL SELECT 'symbols', count(*) FROM symbols UNION ALL SELECT 'relations', count(*) FROM relations UNION ALL SELECT 'commits', count(*) FROM commits",
    ),
    "fallback_weights": _with(
        ["symbols", "commits"],
        """, texts AS (SELECT lower(path) AS t FROM paths UNION ALL SELECT lower(name) FROM symbols UNION ALL SELECT lower(message) FROM commits)
        SELECT token, round(least(2.4, greatest(0.35, 0.65 + ln(((SELECT count(*) FROM texts) + 1) / ((SELECT count(*) FROM texts WHERE contains(t, token)) + 1)))), 6)::DOUBLE AS weight FROM (SELECT unnest(['red', 'widget', 'absentterm']) AS token)""",
    ).replace("\n, texts AS", ",\ntexts AS", 1),
    "note_tags": _with(
        ["notes"],
        f"""SELECT id, CASE WHEN id % 2 = 1 THEN 'api,handler,red' ELSE array_to_string(list_filter(u, lambda t, i: list_position(u, t) = i)[:12], ',') END AS tags FROM (SELECT id, {_useful("(path || ' ' || topic || ' red widget ' || note)")} AS u FROM notes)""",
    ),
    "tag_scores": _plus(
        _plus(_with(["files", "symbols"], ""), _TAGS, ""), _TAG_SCORE,
        "SELECT path, CAST(round(least(8.0, sum(best.weight)), 6) AS DOUBLE) AS score FROM best JOIN files ON files.id = file_id WHERE tag IN ('red', 'widget') GROUP BY path",
    ),
    "combined_tags": _plus(
        _plus(_with(["files", "symbols", "notes"], ""), _TAGS, ""),
        _TAGGED
        + """, said AS (SELECT path, list_transform(list_sort(list((k, tags))), lambda x: x[2]) AS n FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY id DESC) AS k FROM tagged) WHERE k <= 3 GROUP BY path),
        best AS (SELECT file_id, tag, max(weight) AS weight FROM tag_rows GROUP BY ALL), heavy AS (SELECT path, list(tag ORDER BY k) AS t FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY weight DESC, tag) AS k FROM best) JOIN files ON files.id = file_id WHERE k <= 12 GROUP BY path),
        joint AS (SELECT path, list_concat(coalesce(flatten(n), []), coalesce(t, [])) AS u FROM said FULL JOIN heavy USING (path))""",
        "SELECT path, array_to_string(list_filter(u, lambda t, i: list_position(u, t) = i)[:16], ',') AS tags FROM joint",
    ),
}

_THREE = "['red', 'widget', 'sprockets']"
_RECENT_NOTES = """newest_notes AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY id DESC) AS place FROM stale WHERE scope <> 'repo'),
    noted AS (SELECT path, count(*) AS notes, coalesce(bool_or(NOT stale), false) AS fresh, coalesce(bool_or(stale), false) AS stale FROM newest_notes WHERE place <= 3 GROUP BY path)"""
ORACLE_SQL |= {
    "reading_plan_fusion": _plus(
        _with(["feedback", "notes", "symbols"], "").replace("['red', 'widget']", _THREE),
        _TAGGED + ", " + _TAGS + ", " + _RECENT_NOTES
        + f""", graph AS ({ORACLE_SQL["context_pack_full"]}), traced AS (SELECT path, score FROM ({ORACLE_SQL["trace_scores"]}) WHERE score > 0 ORDER BY score DESC, path LIMIT 10),
        asked AS (SELECT id, path, scope, round(len(list_intersect({_THREE}, {_useful("concat_ws(' ', path, topic, note, array_to_string(tags, ' '))")})) / 3 + CASE WHEN contains(lower(topic), 'red widget sprockets') THEN 0.5 ELSE 0.0 END
            + CASE WHEN contains(lower(path), 'red') OR contains(lower(path), 'widget') OR contains(lower(path), 'sprockets') THEN 0.2 ELSE 0.0 END + CASE WHEN list_has_any({_THREE}, tags) THEN 0.4 ELSE 0.0 END, 4) AS score FROM tagged),
        matched AS (SELECT path, max(score) AS score FROM (SELECT * FROM asked WHERE score > 0 ORDER BY score DESC, id DESC LIMIT 20) WHERE scope <> 'repo' GROUP BY path),
        heavy AS (SELECT path, round(least(8.0, sum(weight)), 6) AS score FROM (SELECT file_id, tag, source, max(weight) AS weight FROM tag_rows GROUP BY ALL) JOIN files ON files.id = file_id WHERE tag IN ('red', 'widget', 'sprockets') GROUP BY path),
        every AS (SELECT path FROM graph UNION SELECT path FROM traced UNION SELECT path FROM matched UNION SELECT path FROM signals UNION SELECT path FROM heavy),
        fused AS (SELECT path, 10 * coalesce(g.score, 0) + 0.35 * coalesce(t.score, 0) + 5 * coalesce(m.score, 0) + 1.5 * coalesce(h.score, 0) + 0.4 * coalesce(boost, 0) + 0.8 * coalesce(penalty, 0) + CASE WHEN fresh THEN 3 ELSE 0 END + CASE WHEN n.stale THEN 1 ELSE 0 END AS points,
            (g.path IS NOT NULL)::int + (t.path IS NOT NULL)::int + (m.path IS NOT NULL)::int + (s.path IS NOT NULL)::int + (h.path IS NOT NULL)::int AS sources, coalesce(penalty, 0) AS penalty, g.path IS NOT NULL AS g, t.path IS NOT NULL AS t, m.path IS NOT NULL AS m,
            coalesce(fresh, false) AS fresh, coalesce(n.stale, false) AS is_stale, coalesce(notes, 0) AS notes
            FROM every LEFT JOIN graph g USING (path) LEFT JOIN traced t USING (path) LEFT JOIN matched m USING (path) LEFT JOIN signals s USING (path) LEFT JOIN heavy h USING (path) LEFT JOIN noted n USING (path)),
        listed AS (SELECT path, CAST(round(points, 4) AS DOUBLE) AS score, CAST(sources AS BIGINT) AS sources, CASE WHEN penalty < 0 AND NOT g AND NOT t AND NOT m THEN 'skip_unless_needed' WHEN is_stale THEN 'verify_stale' WHEN t AND NOT g THEN 'inspect_related' WHEN fresh AND NOT g THEN 'use_memory_context' ELSE 'read' END AS action,
            CASE WHEN sources >= 3 OR fresh THEN 'high' WHEN sources >= 2 OR notes > 0 THEN 'medium' ELSE 'low' END AS confidence FROM fused)""",
        "SELECT *, CAST(row_number() OVER (ORDER BY score DESC, path) AS INTEGER) AS rank FROM listed ORDER BY score DESC, path LIMIT 30",
    ),
    "include_edges": _with(
        ["relations"],
        """SELECT source_id AS source, t.id AS target, (CASE WHEN relations.id % 2 = 0 THEN '/' ELSE '' END) || target_id AS target_id, confidence FROM relations JOIN paths s ON s.id = source_id JOIN paths t ON t.path = target_id WHERE relation = 'includes' AND source_id <> t.id""",
    ),
    "task_changes": """SELECT o_orderkey AS id, 'order ' || o_orderkey AS title, CASE WHEN o_orderkey = 1 OR o_orderstatus = 'F' THEN 'done' ELSE 'open' END AS status, CASE WHEN o_orderkey = 1 THEN 't' ELSE o_orderpriority END AS topic,
            'c/' || o_custkey || CASE o_orderkey WHEN 1 THEN ',x.py' WHEN 2 THEN ',y.py' ELSE '' END AS files, CASE o_orderkey WHEN 1 THEN '2030-01-02' WHEN 2 THEN '2030-01-03' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS updated_at,
            CASE WHEN o_orderstatus = 'F' THEN strftime(o_orderdate, '%Y-%m-%d') WHEN o_orderkey = 1 THEN '2030-01-02' END AS closed_at FROM orders
        UNION ALL SELECT max(o_orderkey) + 1, 'new one', 'open', '', 'a/b.py', '2030-01-01', NULL FROM orders""",
    "audit_counts": _with(
        ["notes"],
        f"""WITH_RECENT SELECT 'stale' AS issue, count(*) FILTER (stale) AS notes FROM recent_hundred UNION ALL SELECT 'unknown_evidence', count(*) FROM recent_hundred UNION ALL SELECT 'missing_topic', count(*) FILTER (trim(coalesce(topic, '')) = '') FROM recent_hundred
        UNION ALL SELECT 'short_note', count(*) FILTER (len(list_distinct({_useful("note")})) < 5) FROM recent_hundred UNION ALL SELECT 'duplicate_file_topic', count(*) FROM (SELECT 1 FROM recent_hundred WHERE scope = 'file' GROUP BY path, topic HAVING count(*) > 1)""",
    ).replace("\nWITH_RECENT SELECT", ",\nrecent_hundred AS (SELECT * FROM stale ORDER BY id DESC LIMIT 100)\nSELECT"),
}

ORACLE_SQL["read_sizes"] = _plus(
    _with(["content"], ""),
    f"""pack AS ({ORACLE_SQL["context_pack_full"]}), placed AS (SELECT path, row_number() OVER (ORDER BY raw DESC, path) AS place FROM pack), own AS (SELECT place, text FROM placed JOIN content USING (path) JOIN documents ON doc_id = id),
        sections AS (SELECT 'suggested_first_reads' AS section, length(text) AS n FROM own WHERE place <= 5 UNION ALL SELECT 'top_candidates', length(text) FROM own WHERE place <= 10
            UNION ALL SELECT 'indexed_project', length(content) FROM content WHERE role IN ('source', 'test', 'route', 'view', 'migration', 'documentation', 'config', 'unknown') AND language <> 'unknown')""",
    "SELECT section, count(*) AS files, CAST(sum(n) AS BIGINT) AS characters, CAST(ceil(sum(n) / 4) AS BIGINT) AS tokens FROM sections GROUP BY section",
)

#: Counts that follow a change are those of a full recount.
ORACLE_SQL["refresh_term_stats"] = ORACLE_SQL["term_stats_all"]
ORACLE_SQL["bucket_update"] = _with(
    ["symbols"],
    """, altered AS (
        SELECT id, kind FROM symbols WHERE file_id % 10 <> 7
        UNION ALL SELECT id, 'moved' FROM symbols WHERE file_id % 10 = 7 AND line % 2 = 0)
    SELECT 1 AS version, id, kind FROM symbols UNION ALL SELECT 2, id, kind FROM altered""",
)

#: Every simple path of at most four steps, then the first of each pair: the search itself keeps only the first.
_SIMPLE = """steps AS (
        SELECT relations.id, source_id AS source, t.id AS target, confidence, (CASE WHEN relations.id % 2 = 0 THEN '/' ELSE '' END) || target_id AS said
        FROM relations JOIN paths s ON s.id = source_id JOIN paths t ON t.path = target_id WHERE relation = 'includes' AND source_id <> t.id),
    few AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY 4 + confidence DESC, id, target) AS k FROM steps QUALIFY k <= 25),
    strong AS (SELECT source, target, k, said, confidence FROM few QUALIFY row_number() OVER (PARTITION BY source, target ORDER BY k) = 1),
    simple AS (
        SELECT node AS start, node AS target, [node] AS ids, CAST([] AS BIGINT[]) AS ord, CAST([] AS VARCHAR[]) AS said, CAST([] AS DOUBLE[]) AS sure FROM nodes
        UNION ALL
        SELECT p.start, e.target, list_append(p.ids, e.target), list_append(p.ord, e.k), list_append(p.said, e.said), list_append(p.sure, e.confidence)
        FROM simple p JOIN strong e ON e.source = p.target WHERE NOT list_contains(p.ids, e.target) AND len(p.ids) <= 4),
    firsts AS (SELECT * FROM simple QUALIFY row_number() OVER (PARTITION BY start, target ORDER BY len(ids), ord) = 1)"""
_NODES = "nodes AS (SELECT DISTINCT source_id AS node FROM relations JOIN paths ON paths.id = source_id WHERE source_id % 10 = 1)"


def _recursive(sql: str) -> str:
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


ORACLE_SQL["trace_paths"] = _recursive(
    _plus(
        _with(["relations"], ""), _NODES + ", " + _SIMPLE,
        "SELECT start, target, CAST(len(ids) - 1 AS INTEGER) AS hops, array_to_string(ids, '>') AS path FROM firsts",
    )
)
ORACLE_SQL["trace_targets"] = _recursive(
    _plus(
        _with(["relations"], ""), _NODES + ", " + _SIMPLE,
        "SELECT target, start, CAST(len(ids) - 1 AS INTEGER) AS hops, array_to_string(ids, '>') AS path FROM firsts QUALIFY row_number() OVER (PARTITION BY target ORDER BY len(ids), start, ord) = 1",
    )
)
_TRACE_SCORED = ORACLE_SQL["trace_scores"].rsplit("SELECT path, CAST", 1)[1].replace("id % 12", "distance").replace("FROM content)", "FROM at_distance)").replace("SELECT id, path,", "SELECT id, path, distance,")
_SORTED_TRACE = sorted(set(_TRACE))
_WHY = ", ".join(
    [
        "'reachable from start at distance ' || distance",
        *[
            f"""CASE WHEN contains(lower(path), '{t}') THEN 'path contains "{t}"' END,
            CASE WHEN contains(lower(content), '{t}') THEN 'content contains "{t}"' WHEN contains(list_last(string_split(lower(path), '/')), '{t}') THEN 'filename contains "{t}"' END"""
            for t in _SORTED_TRACE
        ],
        r"""CASE WHEN regexp_matches(lower(content), '<h[1-6]\b|echo\s+[''"]<|<main\b|<title\b|render\(|template') THEN 'emits HTML/render markup' END""",
    ]
)
_PLACE = "len(ids), place, ord"
ORACLE_SQL["trace_query"] = _recursive(
    _plus(
        _with(["content", "relations", "project"], ""),
        f"""begun AS ({ORACLE_SQL["trace_starts"]}), nodes AS (SELECT CAST(id AS BIGINT) AS node FROM begun), {_SIMPLE},
        at_distance AS (SELECT DISTINCT content.id, content.path, content, len(ids) - 1 AS distance FROM simple JOIN content ON content.id = target),
        scored AS (SELECT id, distance, CAST{_TRACE_SCORED}),
        judged AS (SELECT simple.*, place, score, distance, row_number() OVER (ORDER BY score DESC, place, len(ids), ord) AS pos
            FROM simple JOIN scored ON scored.id = target AND distance = len(ids) - 1 JOIN begun ON begun.id = start WHERE score > 0),
        chosen AS (SELECT *, min(pos) OVER (PARTITION BY target) AS spot FROM judged QUALIFY row_number() OVER (PARTITION BY target ORDER BY distance = 0, pos) = 1),
        top AS (SELECT *, row_number() OVER (ORDER BY spot) AS rank FROM chosen ORDER BY spot LIMIT 10),
        steps_of AS (SELECT rank, generate_subscripts(ids, 1) AS i, unnest(ids) AS id FROM top),
        names AS (SELECT rank, list(path ORDER BY i) AS names FROM steps_of JOIN paths USING (id) GROUP BY rank),
        told AS (SELECT rank, list_filter([{_WHY}], lambda x: x IS NOT NULL)[1:8] AS reasons FROM top JOIN content ON content.id = target),
        began AS (SELECT rank, content.path, role, list_filter([{", ".join(f"CASE WHEN contains(lower(path), '{t}') THEN '{t}' END" for t in _SORTED_TRACE)}], lambda x: x IS NOT NULL) AS found FROM top JOIN content ON content.id = start)""",
        """SELECT CAST(rank AS INTEGER) AS rank, names[-1] AS target, round(score, 3) AS score, CAST(distance AS INTEGER) AS distance, array_to_string(names, ' > ') AS trail,
            coalesce(array_to_string(list_transform(range(1, len(names)), lambda i: names[i] || ' ' || names[i + 1] || ' include ' || round(sure[i], 3) || ' followed include relation to ' || said[i]), '; '), '') AS edges,
            CASE WHEN len(found) > 0 THEN 'query matched path tokens: ' || array_to_string(found[1:4], ', ') WHEN role = 'route' THEN 'route file selected as likely runtime start'
                 ELSE list_last(string_split(path, '/')) || ' selected as likely entrypoint/start file' END AS start_reason,
            CASE WHEN distance > 0 THEN names[-1] || ' is reachable through ' || array_to_string(list_transform(said, lambda x: 'include'), ' -> ') || '; ' || reasons[1] ELSE names[-1] || ' is a start file; ' || reasons[1] END AS why_this_path,
            array_to_string(reasons, '; ') AS reasons
        FROM top JOIN names USING (rank) JOIN told USING (rank) JOIN began USING (rank)""",
    )
)

_RECENT_AUDIT = ORACLE_SQL["audit_counts"].rsplit("SELECT 'stale' AS issue", 1)
_CLOSING = ["stale", "unknown_evidence", "missing_topic", "short_note", "duplicate_file_topic"]
_AUDIT_HEAD = _RECENT_AUDIT[0].rstrip()
_AUDIT_CTE = "counted AS (SELECT 'stale' AS issue" + _RECENT_AUDIT[1] + ")"
_TASKS = "tasks AS (SELECT o_orderkey AS id, 'order ' || o_orderkey AS title, strftime(o_orderdate, '%Y-%m-%d') AS updated_at FROM orders WHERE o_orderstatus <> 'F')"
_PLANS = "newest_plans AS (SELECT o_orderkey AS id, o_orderstatus <> 'O' AS finished FROM orders ORDER BY id DESC LIMIT 10)"
ORACLE_SQL["session_close"] = (
    _AUDIT_HEAD
    + f""", {_AUDIT_CTE}, {_TASKS}, {_PLANS},
    amounts AS (SELECT 2 AS git, (SELECT CAST(coalesce(sum(notes), 0) AS BIGINT) FROM counted WHERE issue = 'stale') AS old, (SELECT CAST(coalesce(sum(notes), 0) AS BIGINT) FROM counted WHERE issue <> 'stale') AS poor,
        (SELECT count(*) FROM (SELECT 1 FROM tasks LIMIT 10)) AS open, (SELECT count(*) FROM newest_plans WHERE NOT finished) AS plans),
    rows AS (SELECT unnest([
        {{'position': 1, 'id': 'review_git_status', 'n': git, 's': 'needed'}}, {{'position': 2, 'id': 'refresh_stale_memory', 'n': old, 's': 'needed'}}, {{'position': 3, 'id': 'audit_memory_quality', 'n': poor, 's': 'needed'}},
        {{'position': 4, 'id': 'review_open_tasks', 'n': open, 's': 'needed'}}, {{'position': 5, 'id': 'finish_reading_plans', 'n': plans, 's': 'optional'}}]) AS x FROM amounts)
    SELECT x.position AS position, x.id AS id, CASE WHEN x.n > 0 THEN x.s ELSE 'clean' END AS status, CAST(x.n AS BIGINT) AS amount FROM rows
    UNION ALL SELECT 6, 'record_durable_learning', 'optional', 0 UNION ALL SELECT 7, 'report_verification', 'manual', 0
    UNION ALL SELECT 8, 'close_ready', CASE WHEN git + old + poor + open > 0 THEN 'no' ELSE 'yes' END, 0 FROM amounts"""
)
ORACLE_SQL["session_suggestions"] = _plus(
    _with(["notes", "items"], ""),
    f"""{_PLANS}, placed AS (SELECT *, row_number() OVER (PARTITION BY finished ORDER BY id DESC) AS place FROM newest_plans QUALIFY place <= 5),
    told AS (SELECT place, path, row_number() OVER (PARTITION BY plan_id ORDER BY rank, path) AS nth FROM items JOIN placed ON placed.id = plan_id WHERE finished AND event = 'useful' QUALIFY nth <= 3),
    rows AS (
        SELECT 'feedback' AS part, 'finish_plan' AS kind, 'codemap plan finish --id ' || id || ' --summary <summary>' AS command, 0 AS a, place AS b, 0 AS c FROM placed WHERE NOT finished
        UNION ALL SELECT 'memory', 'memory_for_useful_file', 'codemap memory add --path "' || path || '" --topic <topic> --note <note>', 1, place, nth FROM told
        UNION ALL SELECT 'memory', 'refresh_stale_memory', 'codemap memory update --id ' || id || ' --note <updated-note>', 2, -id, 0 FROM (SELECT * FROM stale ORDER BY id DESC LIMIT 10) WHERE stale)""",
    "SELECT kind, CAST(position AS INTEGER) AS position, command FROM (SELECT *, row_number() OVER (PARTITION BY part ORDER BY a, b, c) AS position FROM rows) WHERE position <= 8",
)
ORACLE_SQL["session_summary"] = (
    _plus(_AUDIT_HEAD, f"feedback AS (SELECT doc_id AS id, (CASE WHEN doc_id % 13 = 0 THEN 'gone/' ELSE '' END) || path AS path, CASE WHEN toxic = 1 THEN 'noisy' WHEN quality = 1 THEN 'useful' ELSE 'neutral' END AS rating FROM labels JOIN paths ON id = doc_id), {_AUDIT_CTE}, {_TASKS}, {_PLANS}", "")
    + """SELECT 'memory' AS section, CAST(row_number() OVER (ORDER BY id DESC) AS INTEGER) AS position, id, path || ': ' || topic AS text FROM (SELECT * FROM stale ORDER BY id DESC LIMIT 5)
    UNION ALL SELECT 'feedback', row_number() OVER (ORDER BY id DESC), id, rating || ' ' || path FROM (SELECT * FROM feedback ORDER BY id DESC LIMIT 5)
    UNION ALL SELECT 'task', row_number() OVER (ORDER BY updated_at DESC, id DESC), id, title FROM (SELECT * FROM tasks ORDER BY updated_at DESC, id DESC LIMIT 5)
    UNION ALL SELECT 'plan', row_number() OVER (ORDER BY id DESC), id, CASE WHEN finished THEN 'finished' ELSE 'unfinished' END FROM (SELECT * FROM newest_plans ORDER BY id DESC LIMIT 5)
    UNION ALL SELECT 'audit', row_number() OVER (ORDER BY issue), NULL, issue || ': ' || notes FROM counted
    UNION ALL SELECT 'git', 1, NULL, ' M a.py'"""
)

_PREPARED = "prepared AS (SELECT id, path, role, language, list_last(string_split(path, '/')) AS name FROM files)"
_LABELLED = "contains(worded.role, token) OR contains(worded.language, token)"
_INSIDE = "length(token) >= 5 AND contains(regexp_replace(lower(regexp_replace(name, '[.][^.]*$', '')), '[^a-z0-9]', '', 'g'), token)"
_PACKS = f"""cases AS (SELECT query AS name, list_sort(list_distinct(list(path)))[:3] AS expected FROM feedback WHERE rating = 'useful' GROUP BY query),
    asked AS (SELECT name AS q, unnest(list_distinct(string_split(name, ' '))) AS token FROM cases),
    token_stats AS (SELECT token, count(term) AS known, {", ".join(f"max(CASE WHEN source = '{x}' THEN weight END) AS w_{x}" for x in ("all", "path", "filename", "language", "role", "symbol", "commit"))}
        FROM (SELECT DISTINCT token FROM asked) LEFT JOIN (SELECT term, source, round(weight, 6) AS weight FROM all_stats) ON term = token GROUP BY token),
    worth AS (SELECT token, {", ".join(f"CASE WHEN known = 0 THEN 0.25 ELSE coalesce(w_{x}, w_all, 1.0) END AS {x}" for x in ("path", "filename", "language", "role", "symbol", "commit"))} FROM token_stats),
    {_PREPARED},
    worded AS (SELECT *, regexp_extract_all(lower(path), '[a-z]+|[0-9]+') AS pt, regexp_extract_all(lower(name), '[a-z]+|[0-9]+') AS nt FROM prepared),
    soft AS (SELECT w.*, {_soft("pt")} AS sp, {_soft("nt")} AS sn, list_contains(pt, token) AS ep, list_contains(nt, token) AS en, {_LABELLED} AS labelled, {_INSIDE} AS inside, worded.path AS file FROM worded, worth w),
    by_token AS (
        SELECT token, file AS path, CAST(CASE WHEN ep THEN 7 * path ELSE 2.5 * path * sp END + CASE WHEN en THEN 5 * filename WHEN inside THEN 4 * filename ELSE 0 END + CASE WHEN en THEN 0 ELSE 2.0 * filename * sn END
            + CASE WHEN labelled THEN 1.5 * greatest(role, language) ELSE 0 END AS DOUBLE) AS score FROM soft
        UNION ALL SELECT token, files.path, 3.5 * symbol * CASE WHEN files.role = 'documentation' THEN CASE WHEN kind IN ('heading', 'command_example') THEN 0.25 ELSE 0.5 END ELSE 1.0 END
            FROM (SELECT file_id, token, arg_min(kind, symbols.id) AS kind FROM symbols, worth WHERE contains(lower(name), token) GROUP BY ALL) JOIN files ON files.id = file_id JOIN worth USING (token)
        UNION ALL SELECT token, path, 2.2 * symbol FROM (SELECT DISTINCT paths.path, token FROM relations JOIN paths ON paths.id = source_id, worth WHERE relation = 'calls' AND contains(lower(target_id), token)) JOIN (SELECT token, symbol FROM worth) USING (token)),
    per_commit AS (SELECT q, commits.id, 0.8 + sum(1.2 * worth.commit) AS amount FROM commits, worth JOIN asked USING (token) WHERE contains(lower(message), token) GROUP BY q, commits.id),
    totals AS (SELECT q, path, sum(score) AS score FROM (SELECT q, path, score FROM asked JOIN by_token USING (token) WHERE score > 0 UNION ALL SELECT q, path, amount FROM commit_files JOIN per_commit ON per_commit.id = commit_id) GROUP BY q, path),
    csuf AS (SELECT q, path, unnest(list_transform(range(1, len(string_split(path, '/')) + 1), lambda i: array_to_string(string_split(path, '/')[i:], '/'))) AS suffix FROM totals),
    cidx AS (SELECT q, suffix, min(path) AS path FROM csuf GROUP BY q, suffix),
    steps AS (SELECT relations.id, f.path AS source, {_STEP} AS step FROM relations JOIN paths f ON f.id = source_id),
    linked AS (SELECT q, id, source, arg_min(path, pri) AS linked FROM (SELECT q, id, source, 0 AS pri, path FROM steps JOIN cidx ON suffix = step UNION ALL SELECT q, id, source, 1, path FROM steps JOIN cidx ON suffix = list_last(string_split(step, '/'))) GROUP BY q, id, source),
    sided AS (SELECT l.*, t.path IS NOT NULL AS inside FROM linked l LEFT JOIN totals t ON t.q = l.q AND t.path = l.source),
    related AS (SELECT q, CASE WHEN inside THEN linked ELSE source END AS path FROM sided WHERE NOT inside OR linked <> source),
    joint AS (SELECT q, path, sum(score) AS score FROM (SELECT * FROM totals UNION ALL SELECT q, path, CAST(least(0.5 * count(*), 1.5) AS DOUBLE) FROM related GROUP BY q, path) GROUP BY q, path),
    judged AS (SELECT q, path, (score * CASE WHEN role = 'test' THEN 0.45 ELSE 1.0 END * CASE WHEN role = 'asset' OR ext IN ('.css', '.scss', '.less') THEN 0.7 ELSE 1.0 END * CASE WHEN role = 'migration' OR ext = '.sql' THEN 0.75 ELSE 1.0 END
        * CASE WHEN role = 'documentation' OR ext IN ('.md', '.rst', '.txt') THEN 0.4 ELSE 1.0 END) AS s, role = 'source' AND ext IN ('.php', '.py', '.js', '.ts', '.go', '.rs') AS code FROM joint JOIN files USING (path) JOIN named USING (path)),
    alike AS (SELECT c.name AS q, f.*, len(list_intersect(string_split(f.query, ' '), string_split(c.name, ' '))) / len(list_distinct(list_concat(string_split(f.query, ' '), string_split(c.name, ' ')))) AS nearness FROM feedback f, cases c),
    contributed AS (SELECT *, nearness * CASE rating WHEN 'useful' THEN 10.0 WHEN 'noisy' THEN -3.0 ELSE 0.0 END * CASE source WHEN 'agent' THEN 1.0 WHEN 'benchmark' THEN 1.1 ELSE 1.2 END AS c FROM alike WHERE nearness >= 0.25),
    learned AS (SELECT q, path, round(least(30.0, sum(greatest(c, 0.0))), 6) AS boost, round(greatest(-5.0, sum(least(c, 0.0))), 6) AS penalty FROM contributed WHERE path IN (SELECT path FROM paths) GROUP BY q, path),
    boosted AS (SELECT q, path, CASE WHEN code THEN s * 1.05 + 0.1 ELSE s END + coalesce(boost, 0) AS b, coalesce(penalty, 0) AS p FROM judged LEFT JOIN learned USING (q, path)),
    best AS (SELECT q, path, CAST(round(CASE WHEN p < 0 AND b > 0 THEN greatest(0.0, b + p) * 0.35 ELSE b END, 6) AS DOUBLE) AS raw FROM boosted QUALIFY row_number() OVER (PARTITION BY q ORDER BY raw DESC, path) <= 10),
    lists AS (SELECT q AS name, list(path ORDER BY raw DESC, path) AS c FROM best WHERE raw > 0 GROUP BY q), j AS (SELECT cases.*, coalesce(c, []) AS c FROM cases LEFT JOIN lists USING (name))"""
_REPORT = "SELECT name, 'ok' AS status" + ORACLE_SQL["retrieval_eval"].rsplit("SELECT name, 'ok' AS status", 1)[1]
#: Not among the others: on the smallest tables DuckDB 1.x ends these with an internal error, after which a connection is of no use.
APART = {}
del ORACLE_SQL["retrieval_eval"]
APART["retrieval_eval"] = _plus(_with(["files", "symbols", "commits", "commit_files", "relations", "feedback"], ""), _ALL_STATS + ", " + _PACKS, _REPORT)
APART["packs_of_queries"] = _plus(
    _with(["files", "symbols", "commits", "commit_files", "relations", "feedback"], ""), _ALL_STATS + ", " + _PACKS,
    "SELECT q AS name, CAST(row_number() OVER (PARTITION BY q ORDER BY raw DESC, path) AS INTEGER) AS rank, path, round(raw, 3) AS raw FROM best WHERE raw > 0",
)
ORACLE_SQL["substring_matches"] = """
    WITH names AS (SELECT DISTINCT lower(p_name) AS name FROM part UNION SELECT DISTINCT o_orderpriority FROM orders),
    tokens AS (SELECT DISTINCT unnest(string_split(lower(substr(p_name, 2)), ' ')) AS token FROM part UNION SELECT 'e' UNION SELECT 'ed')
    SELECT name, token FROM names, tokens WHERE token <> '' AND contains(name, token)"""

ORACLE_SQL["plan_event_items"] = _plus(
    _with(["items"], ""),
    _BUDGET
    + """, listed AS (SELECT plan_id, path, CAST(rank AS INTEGER) AS rank, read_priority, rank AS position FROM budget
        UNION ALL SELECT plan_id, path, CASE WHEN rank % 2 = 0 THEN CAST(rank + 10 AS INTEGER) END, 'skip_unless_needed', rank + 100 FROM budget WHERE rank % 3 = 0),
    latest AS (SELECT * FROM listed QUALIFY row_number() OVER (PARTITION BY plan_id, path ORDER BY position DESC) = 1),
    said AS (SELECT plan_id, path, event FROM items UNION ALL SELECT plan_id, 'extra/' || path, 'read' FROM items WHERE rank = 1)""",
    "SELECT said.event, said.plan_id, said.path, latest.rank AS item_rank, read_priority FROM said LEFT JOIN latest USING (plan_id, path)",
)

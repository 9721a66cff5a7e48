"""Check SQL: the registered queries written a second time, for an independent engine."""

from __future__ import annotations

from snaptext.checks import bindings as bd
from snaptext.functions.html import DROPPED, ENTITIES, LINE_BREAKS, TAG, TITLE
from snaptext.functions.text import BLANK_RUN, BLANKS

_CUR, _OLD, _TODAY = bd.CURRENT, bd.OLD, bd.TODAY


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"trim({x}, {lit(BLANKS)})"


def words(x: str) -> str:
    return f"list_filter(string_split_regex({x}, {lit(BLANK_RUN)}), lambda w: w <> '')"


def tokens(x: str) -> str:
    return (
        f"list_concat(regexp_extract_all(lower({x}), '[a-z0-9]+'), "
        f"list_transform(regexp_extract_all(lower({x}), '[a-z0-9]+-[a-z0-9]+'), lambda p: replace(p, '-', '')))"
    )


def norm(x: str) -> str:
    return f"regexp_replace(lower({x}), '[^a-z0-9]', '', 'g')"


def long_date(x: str) -> str:
    return f"strftime({x}, '%-d %B %Y')"


def boiler(x: str) -> str:
    tests = {
        "prefix": lambda v: f"starts_with({x}, {lit(v)})",
        "contains": lambda v: f"contains({x}, {lit(v)})",
        "equals": lambda v: f"{x} = {lit(v)}",
    }
    return "(" + " OR ".join([f"{x} = ''", f"regexp_full_match({x}, '[0-9]{{1,3}}')", *[tests[k](v) for k, v in bd.RULES]]) + ")"


def bare(x: str) -> str:
    text = strip(f"regexp_replace({x}, '(?i)^\\s*condition\\s+', '')")
    found = f"regexp_extract({text}, '^(\\d+[A-Z]{{0,3}}(?:\\.[A-Z])?)\\b', 1)"
    return f"CASE WHEN {found} = '' THEN {text} ELSE {found} END"


def inverted_lists(rounds: int = 5, sample: int = 16384, most: int = 1024, share: float = 0.6, held: int = 40, n: int = 10) -> str:
    """Centroids of integer codes, the nearest lists of each query, the best rows by code, the best of those by vector."""
    squares = "list_sum(list_transform(list_zip({a}, {b}), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    nearest = lambda rows, centres: f"""
  SELECT vec_id, z, l FROM (
    SELECT r.vec_id, r.z, k.l, row_number() OVER (PARTITION BY r.vec_id ORDER BY {squares.format(a="r.z", b="k.c")}, k.l) AS p FROM {rows} r, {centres} k) WHERE p = 1"""
    steps = "".join(
        f""",
a{i} AS ({nearest("sampled", f"c{i}")}),
m{i} AS (
  SELECT l, list(m ORDER BY d) AS c FROM (
    SELECT l, d, CAST(floor(CAST(sum(z[d]) AS DOUBLE) / count(*)) AS BIGINT) AS m FROM a{i}, range(1, 65) AS ds(d) GROUP BY l, d) GROUP BY l),
c{i + 1} AS MATERIALIZED (SELECT c.l, coalesce(m.c, c.c) AS c FROM c{i} c LEFT JOIN m{i} m USING (l))"""
        for i in range(rounds)
    )
    return f"""
WITH units AS MATERIALIZED (
  SELECT vec_id, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) AS u
  FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)),
codes AS MATERIALIZED (
  SELECT vec_id, u, list_transform(u, lambda x: CAST(greatest(-127, least(127, floor(x * 127 + 0.5))) AS BIGINT)) AS z, row_number() OVER (ORDER BY md5(CAST(vec_id AS VARCHAR))) AS place FROM units),
sampled AS (SELECT vec_id, z, place FROM codes WHERE place <= {sample}),
size AS (SELECT least({most}, floor(2 * sqrt(count(*)) + 0.5), {sample}) AS lists FROM codes),
c0 AS MATERIALIZED (SELECT place - 1 AS l, z AS c FROM sampled, size WHERE place <= lists){steps},
listed AS MATERIALIZED ({nearest("codes", f"c{rounds}")}),
probes AS (
  SELECT vec_id, z, l FROM (
    SELECT q.vec_id, q.z, k.l, row_number() OVER (PARTITION BY q.vec_id ORDER BY {squares.format(a="q.z", b="k.c")}, k.l) AS p
    FROM codes q JOIN benchmark ON item_id = q.vec_id, c{rounds} k), size
  WHERE p <= greatest(1, floor(lists * {share} + 0.5))),
best AS (
  SELECT q, c FROM (
    SELECT q.vec_id AS q, r.vec_id AS c, row_number() OVER (PARTITION BY q.vec_id ORDER BY {squares.format(a="q.z", b="r.z")}, r.vec_id) AS p
    FROM probes q JOIN listed r USING (l)) WHERE p <= {held})
SELECT query_id, rank, vec_id, distance FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM (
    SELECT CAST(q AS VARCHAR) AS query_id, c AS vec_id, round(sqrt({squares.format(a="x.u", b="y.u")}), 6) AS distance
    FROM best JOIN units x ON x.vec_id = q JOIN units y ON y.vec_id = c)) WHERE rank <= {n}"""


def plain(x: str) -> str:
    out = f"regexp_replace({x}, {lit(DROPPED)}, '', 'g')"
    out = f"regexp_replace(regexp_replace({out}, {lit(LINE_BREAKS)}, chr(10), 'g'), {lit(TAG)}, '', 'g')"
    for name, char in ENTITIES:
        out = f"replace({out}, {lit(name)}, {lit(char)})"
    return out


def _values(rows: list[tuple]) -> str:
    cell = lambda v: lit(v) if isinstance(v, str) else "[" + ", ".join(map(lit, v)) + "]" if isinstance(v, list) else str(v)
    return "VALUES " + ", ".join("(" + ", ".join(cell(v) for v in row) + ")" for row in rows)


def _days(days: list[str]) -> str:
    return "unnest([" + ", ".join(f"DATE {lit(d)}" for d in days) + "])"


# Shared steps: name -> (steps it reads, SQL).
STEPS: dict[str, tuple[list[str], str]] = {}


def step(name: str, needs: str, sql: str) -> None:
    STEPS[name] = (needs.split(), sql)


def with_steps(needs: str, select: str) -> str:
    order: list[str] = []

    def add(name: str) -> None:
        for other in STEPS[name][0]:
            add(other)
        if name not in order:
            order.append(name)

    for name in needs.split():
        add(name)
    if not order:
        return select
    return "WITH " + ",\n".join(f"{n} AS MATERIALIZED ({STEPS[n][1]})" for n in order) + "\n" + select


# Documents in two editions and their chunks.
step("doc_lines", "", "SELECT CAST(doc_id AS VARCHAR) AS entity_id, source AS section, text, string_split(text, chr(10)) AS ls FROM documents")
step("editions", "doc_lines", f"""
SELECT '{_CUR}' AS snapshot, entity_id, CASE WHEN len(ls) > 1 THEN {strip('ls[1]')} ELSE section END AS title, section,
  1 AS page_start, len(ls) AS page_end, CASE WHEN len(ls) > 1 THEN array_to_string(ls[2:], chr(10)) ELSE text END AS body
FROM doc_lines
UNION ALL
SELECT '{_OLD}', entity_id, {strip('ls[1]')}, section, 1, len(ls), array_to_string(ls[2:len(ls)-1], chr(10))
FROM doc_lines WHERE len(ls) > 1""")
_STUBBED = f"CASE WHEN coalesce({strip('body')}, '') = '' THEN 'Condition ' || entity_id || ': ' || title ELSE body END"
step("doc_words", "editions", f"SELECT snapshot, entity_id, title, section, page_start, page_end, {words(_STUBBED)} AS ws FROM editions")


def windows(source: str, columns: str) -> str:
    return (
        f"SELECT {columns}, i AS chunk_index, array_to_string(ws[i*150+1 : i*150+175], ' ') AS text, "
        f"len(ws[i*150+1 : i*150+175]) AS n_words, snapshot || '__' || entity_id || '_' || i AS chunk_id FROM "
        f"(SELECT *, unnest(generate_series(0, CASE WHEN len(ws) <= 175 THEN 0 ELSE CAST(ceil((len(ws) - 25) / 150.0) AS BIGINT) - 1 END)) AS i FROM {source})"
    )


step("chunks", "doc_words", windows("doc_words", "snapshot, entity_id, title, section, page_start, page_end"))

# Questions and sub-queries.
step("questions", "", """
SELECT CAST(item_id AS VARCHAR) AS query_id, text, make_date(2020 + item_id % 4, 6, 1) AS as_of,
  len(string_split_regex(text, '\\.\\s+')) >= 3 AS is_broad FROM benchmark""")
step("planned", "questions", """
SELECT query_id, generate_subscripts(s, 1) - 1 AS plan_no, unnest(s) AS text
FROM (SELECT query_id, string_split_regex(text, '\\.\\s+') AS s FROM questions)""")
step("hint_table", "", "SELECT * FROM (" + _values([(i, t, s) for i, (t, s) in enumerate(bd.HINTS)]) + ") AS h(hint, triggers, stored)")
step("hint_rows", "questions hint_table", """
SELECT query_id, hint, generate_subscripts(stored, 1) AS pos, unnest(stored) AS text
FROM questions JOIN hint_table ON len(list_filter(triggers, lambda t: contains(lower(text), t))) > 0 WHERE is_broad""")
step("hints", "hint_rows", """
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY hint, pos) AS hint_no, text
FROM (SELECT * FROM hint_rows WHERE text <> '' QUALIFY row_number() OVER (PARTITION BY query_id, lower(text) ORDER BY hint, pos) = 1)""")
step("asked", "questions hints planned", """
SELECT query_id, sub_no, text FROM (
  SELECT query_id, text, row_number() OVER (PARTITION BY query_id ORDER BY kind, pos) - 1 AS sub_no FROM (
    SELECT * FROM (
      SELECT query_id, 0 AS kind, 0 AS pos, text FROM questions
      UNION ALL SELECT query_id, 1, hint_no, text FROM hints
      UNION ALL SELECT query_id, 2, plan_no, trim(text) FROM planned)
    WHERE text <> '' QUALIFY row_number() OVER (PARTITION BY query_id, lower(text) ORDER BY kind, pos) = 1)) a
LEFT JOIN (SELECT query_id AS q, count(*) AS n FROM hints GROUP BY 1) h ON a.query_id = h.q
WHERE sub_no < 6 + coalesce(n, 0)""")
step("aliases", "", "SELECT * FROM (" + _values([(k, v) for k, v in bd.ALIASES.items()]) + ") AS a(phrase, extra)")
step("query_terms", "asked aliases", f"""
SELECT query_id, sub_no, term, count(*) AS qtf FROM (
  SELECT query_id, sub_no, unnest({tokens('text')}) AS term FROM asked
  UNION ALL SELECT query_id, sub_no, unnest(extra) FROM asked JOIN aliases ON contains(lower(text), phrase))
GROUP BY ALL""")

# Lexical index and scores.
step("chunk_tokens", "chunks", f"SELECT entity_id, chunk_index, {tokens('text')} AS b, {tokens('title')} AS t FROM chunks WHERE snapshot = '{_CUR}'")
step("postings", "chunk_tokens", """
SELECT entity_id, chunk_index, len_body, len_title, term, sum(nb) AS tf_body, sum(nt) AS tf_title FROM (
  SELECT entity_id, chunk_index, len(b) AS len_body, len(t) AS len_title, unnest(b) AS term, 1 AS nb, 0 AS nt FROM chunk_tokens
  UNION ALL SELECT entity_id, chunk_index, len(b), len(t), unnest(t), 0, 1 FROM chunk_tokens) GROUP BY ALL""")
step("sizes", "chunk_tokens", "SELECT count(*) AS n, sum(len(b)) AS body, sum(len(t)) AS title FROM chunk_tokens")
step("raw_idf", "postings sizes", """
SELECT term, df, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM (SELECT term, count(*) AS df FROM postings GROUP BY 1), sizes""")
step("idf", "raw_idf", "SELECT term, df, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raw_idf) ELSE raw END AS idf FROM raw_idf")


def scored(weight: int, terms: str = "query_terms") -> str:
    return f"""
SELECT query_id, sub_no, entity_id, chunk_index, round(sum(qtf * idf * ((tf_body + {weight} * tf_title) * 2.5)
  / ((tf_body + {weight} * tf_title) + 1.5 * (0.25 + 0.75 * (len_body + {weight} * len_title) / avg_len))), 6) AS score
FROM {terms} JOIN idf USING (term) JOIN postings USING (term), (SELECT (body + {weight} * title) / n AS avg_len FROM sizes)
GROUP BY ALL"""


def ranked(source: str, order: str, n: int, columns: str) -> str:
    return f"""SELECT query_id, sub_no, rank, {columns} FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id, sub_no ORDER BY {order}) AS rank FROM ({source})) WHERE rank <= {n}"""


step("lexical", "query_terms idf postings sizes", ranked(scored(8), "score DESC, entity_id, chunk_index", 40, "entity_id, chunk_index, score"))

# Hashed vectors and nearest chunks.
_SLOT = "CAST('0x' || substr(md5(term), 1, 8) AS BIGINT) % 64"
_SIGN = "CASE WHEN substr(md5(term), 9, 1) >= '8' THEN -1 ELSE 1 END"


def hashed(source: str, keys: str, count: str) -> str:
    return f"""
SELECT {keys}, list_transform(generate_series(0, 63), lambda i: CAST(coalesce(m[i], 0) AS DOUBLE)) AS v FROM (
  SELECT {keys}, map_from_entries(list((slot, value))) AS m FROM (
    SELECT {keys}, {_SLOT} AS slot, CAST(sum({count} * {_SIGN}) AS BIGINT) AS value FROM {source} GROUP BY ALL) GROUP BY ALL)"""


_WEIGHT = "CAST(round(idf * 1000) AS BIGINT)"
step("chunk_vectors", "postings idf", hashed("(SELECT * FROM postings JOIN idf USING (term) WHERE tf_body > 0)", "entity_id, chunk_index", f"tf_body * {_WEIGHT}"))
step("query_vectors", "asked idf", hashed(f"(SELECT * FROM (SELECT query_id, sub_no, unnest({tokens('text')}) AS term FROM asked) JOIN idf USING (term))", "query_id, sub_no", _WEIGHT))
step("distances", "query_vectors chunk_vectors", """
SELECT query_id, sub_no, entity_id, chunk_index, greatest(0.0, 1.0 - list_inner_product(q.v, c.v) / sqrt(qn * cn)) AS distance
FROM (SELECT *, list_inner_product(v, v) AS qn FROM query_vectors) q, (SELECT *, list_inner_product(v, v) AS cn FROM chunk_vectors) c
WHERE qn > 0 AND cn > 0""")
step("nearest", "distances", ranked("FROM distances", "distance, entity_id, chunk_index", 40, "entity_id, chunk_index, distance"))

# Fusion, union.
step("fused", "nearest lexical", """
SELECT *, row_number() OVER (PARTITION BY query_id, sub_no ORDER BY score DESC, list_no, first_rank) AS rank FROM (
  SELECT query_id, sub_no, entity_id, chunk_index, round(sum(1.0 / (60 + rank)), 12) AS score,
    min(list_no) AS list_no, arg_min(rank, list_no) AS first_rank FROM (
    SELECT query_id, sub_no, rank, entity_id, chunk_index, 1 AS list_no FROM nearest WHERE rank <= 10
    UNION ALL SELECT query_id, sub_no, rank, entity_id, chunk_index, 2 FROM lexical WHERE rank <= 10) GROUP BY ALL)
""")
STEPS["fused"] = (STEPS["fused"][0], STEPS["fused"][1].replace("GROUP BY ALL)", "GROUP BY query_id, sub_no, entity_id, chunk_index)"))
step("demoted", "", "SELECT CAST(doc_id AS VARCHAR) AS entity_id FROM labels WHERE toxic = 1")
step("hits", "fused demoted nearest", """
SELECT h.query_id, h.sub_no, h.rank, h.entity_id, h.chunk_index, h.score, h.demoted, n.distance FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id, sub_no ORDER BY demoted, fused_rank) AS rank FROM (
    SELECT query_id, sub_no, entity_id, chunk_index, score, rank AS fused_rank,
      entity_id IN (SELECT entity_id FROM demoted) AS demoted FROM fused)) h
LEFT JOIN (SELECT * FROM nearest WHERE rank <= 10) n
  ON n.query_id = h.query_id AND n.sub_no = h.sub_no AND n.entity_id = h.entity_id AND n.chunk_index = h.chunk_index
WHERE h.rank <= 6""")
step("unioned", "hits", """
SELECT query_id, rank, entity_id, chunk_index, distance FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY r, s) AS rank FROM (
    SELECT query_id, entity_id, chunk_index, rank AS r, sub_no AS s, distance FROM hits
    QUALIFY row_number() OVER (PARTITION BY query_id, entity_id, chunk_index ORDER BY rank, sub_no) = 1)) WHERE rank <= 40""")

# Histories of labelled documents.
step("doc_about", "editions", """
SELECT entity_id, max(title) AS title, CASE WHEN max(quality) = 1 THEN CAST(min(snapshot) AS DATE) END AS introduced
FROM editions JOIN (SELECT CAST(doc_id AS VARCHAR) AS entity_id, quality FROM labels) USING (entity_id) GROUP BY 1""")
step("doc_starts", "editions doc_about", """
SELECT entity_id, CAST(snapshot AS DATE) AS start, snapshot, 'edition of ' || snapshot AS note
FROM editions WHERE entity_id IN (SELECT entity_id FROM doc_about)""")


def timeline(starts: str, about: str) -> str:
    return f"""
SELECT s.*, coalesce(a.title, s.entity_id) AS title, a.introduced FROM (
  SELECT entity_id, row_number() OVER w - 1 AS seg_idx, start, lead(start) OVER w AS "end", snapshot, note,
    count(*) OVER (PARTITION BY entity_id) AS n_segments, min(start) OVER (PARTITION BY entity_id) AS first_start
  FROM {starts} WINDOW w AS (PARTITION BY entity_id ORDER BY start)) s LEFT JOIN {about} a USING (entity_id)"""


def resolved(probes: str, line: str) -> str:
    """Interval join, the other way to find the segment in force."""
    return f"""
SELECT p.entity_id, p.as_of, p.n_probes, s.seg_idx, s.start, s."end", s.snapshot, s.note,
  f.n_segments, f.start AS first_start, f."end" AS first_end, f.title, f.introduced,
  CASE WHEN f.entity_id IS NULL THEN 'UNMAPPED' WHEN p.as_of < f.start THEN 'TOO_EARLY' WHEN s.entity_id IS NULL THEN 'GAP' ELSE 'IN_FORCE' END AS state
FROM (SELECT entity_id, as_of, count(*) AS n_probes FROM {probes} GROUP BY ALL) p
LEFT JOIN {line} s ON s.entity_id = p.entity_id AND s.start <= p.as_of AND (s."end" IS NULL OR p.as_of < s."end")
LEFT JOIN (SELECT * FROM {line} WHERE seg_idx = 0) f ON f.entity_id = p.entity_id"""


_SERVED = """CASE WHEN state = 'IN_FORCE' THEN snapshot WHEN state = 'TOO_EARLY' AND introduced IS NULL THEN NULL ELSE {current} END"""
_IDX = "CASE state WHEN 'IN_FORCE' THEN seg_idx WHEN 'TOO_EARLY' THEN 0 WHEN 'GAP' THEN n_segments - 1 END"
_CHANGE_IDX = f"CASE WHEN {_IDX} >= 1 THEN {_IDX} WHEN {_IDX} = 0 AND n_segments > 1 THEN 1 END"
_CHANGE_DATE = f"CASE WHEN {_IDX} >= 1 THEN start WHEN {_IDX} = 0 THEN first_end END"

step("doc_line", "doc_starts doc_about", timeline("doc_starts", "doc_about"))
step("doc_probes", "unioned questions", "SELECT u.entity_id, q.as_of FROM unioned u JOIN questions q USING (query_id)")
step("doc_resolved", "doc_probes doc_line", resolved("doc_probes", "doc_line"))
step("served", "unioned questions doc_resolved", f"""
SELECT DISTINCT u.query_id, u.entity_id, r.as_of, {_SERVED.format(current=lit(_CUR))} AS snapshot
FROM unioned u JOIN questions q USING (query_id) JOIN doc_resolved r ON r.entity_id = u.entity_id AND r.as_of = q.as_of""")
step("entity_rank", "unioned", """
SELECT query_id, entity_id, row_number() OVER (PARTITION BY query_id ORDER BY min(rank)) AS entity_rank FROM unioned GROUP BY 1, 2""")
step("chunk_counts", "chunks", "SELECT snapshot, entity_id, count(*) AS n_chunks FROM chunks GROUP BY 1, 2")


def wanted(whole: int, strong: int, strong_whole: int) -> str:
    return f"""
SELECT DISTINCT h.query_id, h.entity_rank, h.snapshot, h.entity_id, c.chunk_index, h.whole_entity FROM (
  SELECT u.query_id, u.entity_id, u.chunk_index, e.entity_rank, s.snapshot,
    s.snapshot <> '{_CUR}' OR n.n_chunks <= {whole} OR (e.entity_rank <= {strong} AND n.n_chunks <= {strong_whole}) AS whole_entity
  FROM unioned u JOIN served s USING (query_id, entity_id) JOIN entity_rank e USING (query_id, entity_id)
  JOIN chunk_counts n ON n.snapshot = s.snapshot AND n.entity_id = u.entity_id) h
JOIN chunks c ON c.snapshot = h.snapshot AND c.entity_id = h.entity_id AND (h.whole_entity OR abs(c.chunk_index - h.chunk_index) <= 1)"""


step("wanted", "unioned served entity_rank chunk_counts chunks", wanted(8, 2, 30))
step("ordered", "wanted chunks", """
SELECT w.query_id, w.entity_rank, row_number() OVER (PARTITION BY w.query_id ORDER BY w.entity_rank, w.chunk_index) AS place, c.*
FROM wanted w JOIN chunks c USING (snapshot, entity_id, chunk_index)""")
step("blocks", "ordered", f"""
SELECT query_id, block_no, entity_id, snapshot, '[' || block_no || '] ' || entity_id || ' | ' || title || ' | snapshot of ' ||
  {long_date('CAST(snapshot AS DATE)')} || ' | ' || section || ' | pages ' || page_start || '-' || page_end || chr(10) || body AS block FROM (
  SELECT query_id, entity_rank, snapshot, entity_id, row_number() OVER (PARTITION BY query_id ORDER BY entity_rank) AS block_no,
    string_agg(text, ' ' ORDER BY chunk_index) AS body, min(title) AS title, min(section) AS section, min(page_start) AS page_start, min(page_end) AS page_end
  FROM ordered GROUP BY 1, 2, 3, 4)""")
step("doc_changes", "doc_line", f"""
SELECT entity_id, coalesce(string_agg({long_date('start')}, ', ' ORDER BY start) FILTER (seg_idx > 0), '') AS change_dates FROM doc_line GROUP BY 1""")


def change_facts(source: str, dates: str) -> str:
    name = "entity_id || ' (' || title || ')'"
    return f"""
SELECT entity_id, as_of, state, CASE
  WHEN state = 'IN_FORCE' THEN {name} || ' changed on ' || change_dates || '; on ' || {long_date('as_of')} || ' the text of snapshot ' || snapshot
    || ' applied, from ' || {long_date('start')} || coalesce(' until ' || {long_date('"end"')}, ' to now') || ': ' || note
  WHEN introduced IS NOT NULL THEN {name} || ' came in on ' || {long_date('introduced')} || '; on ' || {long_date('as_of')}
    || ' it did not exist yet, so nothing in it applied.'
  ELSE {name} || ' changed on ' || change_dates || '; the earliest text held is of ' || {long_date('first_start')}
    || ', so its text on ' || {long_date('as_of')} || ' cannot be confirmed.' END AS fact
FROM {source} JOIN {dates} USING (entity_id) WHERE state IN ('TOO_EARLY', 'IN_FORCE')"""


step("doc_facts", "doc_resolved doc_changes", change_facts("doc_resolved", "doc_changes"))
step("fact_texts", "served doc_facts doc_about unioned questions", f"""
SELECT query_id, string_agg('- ' || fact, chr(10) ORDER BY kind, entity_id, fact) AS facts FROM (
  SELECT DISTINCT s.query_id, s.entity_id, 2 AS kind, f.fact FROM served s JOIN doc_facts f USING (entity_id, as_of)
  UNION ALL SELECT DISTINCT u.query_id, a.entity_id, 1, a.entity_id || ' (' || a.title || ') came in on ' || {long_date('a.introduced')} || '; on ' || {long_date('q.as_of')} || ' '
    || CASE WHEN q.as_of >= a.introduced THEN 'it was in force with its current text' ELSE 'it did not exist yet' END || '.'
  FROM unioned u JOIN questions q USING (query_id) JOIN doc_about a ON a.entity_id = u.entity_id WHERE a.introduced IS NOT NULL) GROUP BY 1""")
step("covered", "unioned", """
SELECT query_id, string_agg(entity_id, ', ' ORDER BY entity_id) AS covered FROM (SELECT DISTINCT query_id, entity_id FROM unioned)
WHERE entity_id IN (SELECT CAST(doc_id AS VARCHAR) FROM labels) GROUP BY 1""")
_SCOPE = f"""CASE WHEN as_of < DATE '{_TODAY}' THEN 'As of ' || {long_date('as_of')} || ' history is known only for ' || coalesce(covered, 'no entity')
  || '; every other text is the current one ({_CUR}) and cannot be confirmed for that date.' END"""
step("citations", "unioned", f"""
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS cite_no, entity_id, title, pages FROM (
  SELECT query_id, rank, {bare("'Condition ' || entity_id || ' - as cited'")} AS entity_id, 'title ' || entity_id AS title, CAST(rank AS VARCHAR) AS pages FROM unioned
  QUALIFY row_number() OVER (PARTITION BY query_id, entity_id ORDER BY rank) = 1)""")

# Orders as timelines.
step("users", "", """
SELECT CAST(user_id AS VARCHAR) AS number, 'u' || user_id AS entity_id, 'user ' || user_id AS title, CAST(min(ts) AS DATE) AS introduced
FROM events WHERE event_type = 'signup' GROUP BY user_id""")
step("order_starts", "", """
SELECT CAST(o_custkey AS VARCHAR) AS entity_id, CAST(o_orderdate AS DATE) AS start, o_orderstatus AS snapshot, o_orderpriority AS note FROM orders
QUALIFY row_number() OVER (PARTITION BY o_custkey, CAST(o_orderdate AS DATE) ORDER BY o_orderkey DESC) = 1""")
step("order_about", "users", "SELECT number AS entity_id, title, DATE '1995-01-01' AS introduced FROM users")
step("order_line", "order_starts order_about", timeline("order_starts", "order_about"))
step("probes", "users", f"""
SELECT CAST(c_custkey AS VARCHAR) AS entity_id, {_days(bd.PROBE_DAYS)} AS as_of FROM customer
UNION ALL SELECT entity_id, {_days(bd.PROBE_DAYS)} FROM users""")
step("segs", "probes order_line", resolved("probes", "order_line"))
step("order_dates", "order_line", STEPS["doc_changes"][1].replace("doc_line", "order_line"))


def notes(source: str) -> str:
    not_yet = f"'; did not exist on ' || {long_date('as_of')}"
    return f"""
SELECT r.entity_id, as_of, CASE
  WHEN state = 'IN_FORCE' THEN 'snapshot ' || snapshot || CASE WHEN r.introduced IS NOT NULL OR seg_idx > 0 THEN '; this wording from ' || {long_date('start')} ELSE '' END
  WHEN state = 'TOO_EARLY' AND r.introduced IS NOT NULL THEN 'introduced ' || {long_date('r.introduced')} || {not_yet}
  WHEN state <> 'UNMAPPED' THEN '' WHEN u.introduced IS NULL THEN ''
  WHEN as_of >= u.introduced THEN 'introduced ' || {long_date('u.introduced')}
  ELSE 'introduced ' || {long_date('u.introduced')} || {not_yet} END AS note
FROM {source} r LEFT JOIN users u ON u.entity_id = r.entity_id"""


def view(source: str) -> str:
    return f"""
SELECT r.entity_id, as_of, CASE WHEN state <> 'UNMAPPED' THEN 'text-change' ELSE 'introduced' END AS kind,
  CASE WHEN state <> 'UNMAPPED' THEN r.title ELSE u.title END AS title,
  CASE WHEN state <> 'UNMAPPED' THEN {_CHANGE_IDX} END AS change_idx,
  CASE WHEN state <> 'UNMAPPED' THEN {long_date(_CHANGE_DATE)} END AS change_date,
  CASE WHEN state <> 'UNMAPPED' THEN {_IDX} >= 1 END AS on_after,
  CASE WHEN state <> 'UNMAPPED' THEN {long_date(f"CASE WHEN {_IDX} = 0 THEN first_start ELSE start END")} END AS showing,
  CASE WHEN state = 'UNMAPPED' THEN {long_date('u.introduced')} END AS introduced,
  CASE WHEN state = 'UNMAPPED' THEN as_of >= u.introduced END AS existed
FROM {source} r LEFT JOIN users u ON u.entity_id = r.entity_id WHERE state <> 'UNMAPPED' OR u.entity_id IS NOT NULL"""


# Conversations.
step("turns", "", "SELECT CAST(conv_id AS VARCHAR) AS entity_id, CAST(turn AS BIGINT) AS idx, text, role FROM conversations")
step("pairs", "turns", "SELECT n.entity_id, n.idx, o.text AS old, n.text AS new FROM turns n JOIN turns o ON o.entity_id = n.entity_id AND o.idx = n.idx - 1")
step("turn_starts", "turns", "SELECT entity_id, CAST(DATE '2024-01-01' + to_months(CAST(idx AS INTEGER)) AS DATE) AS start, CAST(idx AS VARCHAR) AS snapshot, role AS note FROM turns")
step("turn_about", "", "SELECT CAST(doc_id AS VARCHAR) AS entity_id, 'conversation ' || doc_id AS title, DATE '2024-01-01' AS introduced FROM labels WHERE quality = 1")
step("turn_line", "turn_starts turn_about", timeline("turn_starts", "turn_about"))
step("turn_probes", "turns", f"SELECT entity_id, {_days(bd.TURN_DAYS)} AS as_of FROM (SELECT DISTINCT entity_id FROM turns)")
step("turn_segs", "turn_probes turn_line", resolved("turn_probes", "turn_line"))


def sides(source: str, line: str) -> str:
    return f"""
SELECT a.entity_id, a.as_of, a.change_idx, {long_date('n.start')} AS change_date, n.note, o.snapshot AS old_snapshot,
  {long_date('o.start')} || ' - ' || {long_date('n.start')} AS old_in_force, n.snapshot AS new_snapshot,
  CASE WHEN n."end" IS NULL THEN 'from ' || {long_date('n.start')} || ' (current)' ELSE {long_date('n.start')} || ' - ' || {long_date('n."end"')} END AS new_in_force
FROM (SELECT entity_id, as_of, {_CHANGE_IDX} AS change_idx FROM {source}) a
JOIN {line} n ON n.entity_id = a.entity_id AND n.seg_idx = a.change_idx
JOIN {line} o ON o.entity_id = a.entity_id AND o.seg_idx = a.change_idx - 1"""


step("turn_sides", "turn_segs turn_line", sides("turn_segs", "turn_line"))
step("turn_view", "turn_segs users", view("turn_segs"))
step("turn_markers", "turn_line", f"""
SELECT entity_id, seg_idx AS marker_no, {long_date('start')} AS date,
  CASE WHEN seg_idx > 0 THEN 'text changed' WHEN introduced IS NOT NULL THEN 'introduced' ELSE 'original text' END AS label, note FROM turn_line""")
step("invariant", "turn_view turn_sides turn_markers", """
SELECT v.entity_id, v.as_of, v.change_date, coalesce(s.change_date = v.change_date AND EXISTS (
  SELECT 1 FROM turn_markers m WHERE m.entity_id = v.entity_id AND m.date = v.change_date), FALSE) AS consistent
FROM turn_view v LEFT JOIN turn_sides s ON s.entity_id = v.entity_id AND s.as_of = v.as_of""")

# Word diffs: partners found round by round, as window functions.
def alignment(source: str, keys: str, rounds: tuple) -> str:
    """CTE list that ends in ``aligned``: ``keys, side, pos, word, partner, gap`` of the words of ``source`` (``keys, side, pos, word``)."""
    ctes = [f"r0 AS (SELECT {keys}, side, pos, word, CAST(NULL AS BIGINT) AS partner FROM ({source}))"]
    gap = f"PARTITION BY {keys}, side, gap, open"
    for i, way in enumerate(rounds):
        ctes.append(f"g{i} AS (SELECT *, count(partner) OVER (PARTITION BY {keys}, side ORDER BY pos) AS gap, partner IS NULL AS open FROM r{i})")
        if isinstance(way, str):
            at = f"row_number() OVER ({gap} ORDER BY pos {'DESC' if way == 'end' else 'ASC'})"
            ctes.append(f"p{i} AS (SELECT *, {at} AS turn_at FROM g{i})")
            across = f"(PARTITION BY {keys}, gap, open, turn_at)"
            ctes.append(f"q{i} AS (SELECT *, count(*) OVER {across} = 2 AND min(word) OVER {across} = max(word) OVER {across} AS same, sum(pos) OVER {across} - pos AS other FROM p{i})")
            found = f"CASE WHEN open AND bool_and(same) OVER ({gap} ORDER BY turn_at) THEN other END"
        else:
            run = " || ' ' || ".join(["word", *[f"lead(word, {j}) OVER ({gap} ORDER BY pos)" for j in range(1, way)]])
            ctes.append(f"p{i} AS (SELECT *, {run} AS run FROM g{i})")
            across = f"(PARTITION BY {keys}, gap, open, run)"
            ctes.append(f"q{i} AS (SELECT *, CASE WHEN open AND run IS NOT NULL AND count(*) OVER {across} = 2 AND sum(side) OVER {across} = 1 THEN sum(pos) OVER {across} - pos END AS other FROM p{i})")
            found = f"""CASE WHEN coalesce(max(other) OVER ({gap} ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) < other, TRUE)
  AND coalesce(min(other) OVER ({gap} ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) > other, TRUE) THEN other END"""
        ctes.append(f"r{i + 1} AS (SELECT {keys}, side, pos, word, coalesce(partner, {found}) AS partner FROM q{i})")
    n = len(rounds)
    ctes.append(f"aligned AS (SELECT *, count(partner) OVER (PARTITION BY {keys}, side ORDER BY pos) AS gap FROM r{n})")
    return ",\n".join(ctes)


_WAYS = (3, "start", "end", 1, "start", "end")
step("diff_words", "pairs", f"""
WITH {alignment(f"SELECT entity_id, idx, side, generate_subscripts(ws, 1) - 1 AS pos, unnest(ws) AS word FROM (SELECT entity_id, idx, 0 AS side, {words('old')} AS ws FROM pairs UNION ALL SELECT entity_id, idx, 1, {words('new')} FROM pairs)", "entity_id, idx", _WAYS)},
placed AS (
  SELECT *, row_number() OVER (PARTITION BY entity_id, idx ORDER BY gap - CAST(op = 'eq' AS INT), op = 'eq', side, pos) AS place
  FROM (SELECT *, CASE WHEN partner IS NOT NULL THEN 'eq' WHEN side = 0 THEN 'del' ELSE 'add' END AS op FROM aligned WHERE side = 0 OR partner IS NULL)),
marked AS (SELECT *, coalesce(lag(op) OVER (PARTITION BY entity_id, idx ORDER BY place) <> op, TRUE) AS starts FROM placed)
SELECT entity_id, idx, place, op, word, sum(CAST(starts AS INT)) OVER (PARTITION BY entity_id, idx ORDER BY place) AS run FROM marked""")
step("diff_sides", "diff_words", """
SELECT entity_id, idx, string_agg(op || ' ' || t, chr(10) ORDER BY run) FILTER (op <> 'add') AS old_side, string_agg(op || ' ' || t, chr(10) ORDER BY run) FILTER (op <> 'del') AS new_side
FROM (SELECT entity_id, idx, run, op, string_agg(word, ' ' ORDER BY place) AS t FROM diff_words GROUP BY 1, 2, 3, 4) GROUP BY 1, 2""")
# Contexts of 6 words, at most 140 changed words.
step("diff_shown", "diff_words pairs", """
WITH sized AS (
  SELECT *, sum(CAST(op <> 'eq' AS INT)) OVER (PARTITION BY entity_id, idx ORDER BY place) AS so_far, sum(CAST(op <> 'eq' AS INT)) OVER (PARTITION BY entity_id, idx) AS in_all,
    max(run) OVER (PARTITION BY entity_id, idx) AS runs, row_number() OVER (PARTITION BY entity_id, idx, run ORDER BY place) AS nth, count(*) OVER (PARTITION BY entity_id, idx, run) AS size
  FROM diff_words),
named AS (
  SELECT *, CASE WHEN op <> 'eq' THEN op WHEN in_all > 0 AND (size <= 12 OR (run > 1 AND nth <= 6) OR (run < runs AND size - nth < 6)) THEN 'context'
    WHEN run > 1 AND run < runs AND nth = 7 THEN 'gap' END AS kind
  FROM sized WHERE CASE WHEN op <> 'eq' THEN so_far <= 140 ELSE so_far < 140 OR in_all <= 140 END),
pieces AS (
  SELECT *, sum(CAST(kind = 'gap' AS INT)) OVER (PARTITION BY entity_id, idx, run ORDER BY place) AS piece FROM named WHERE kind IS NOT NULL),
regions AS (
  SELECT entity_id, idx, min(place) AS place, kind, string_agg(CASE WHEN kind = 'gap' THEN chr(8230) ELSE word END, ' ' ORDER BY place) AS t, max(in_all) > 140 AS truncated
  FROM pieces GROUP BY entity_id, idx, run, piece, kind)
SELECT p.entity_id, p.idx, coalesce(diff, '') AS diff, coalesce(truncated, FALSE) AS truncated
FROM pairs p LEFT JOIN (
  SELECT entity_id, idx, string_agg(kind || ' ' || t, chr(10) ORDER BY place) AS diff, bool_or(truncated) AS truncated FROM regions GROUP BY 1, 2) USING (entity_id, idx)""")

# Snapshots of customers; presence and classes by plain window functions.
step("cust_texts", "", f"""
SELECT CAST(o_custkey AS VARCHAR) AS entity_id, (year(o_orderdate) - (SELECT min(year(o_orderdate)) FROM orders)) // {bd.YEARS_PER_SNAPSHOT} AS idx, max(o_orderstatus) AS text
FROM orders GROUP BY ALL""")


def grid(texts: str, n: str, min_chars: int) -> str:
    return f"""
SELECT e.entity_id, s.idx, t.norm, coalesce(length(t.norm) >= {min_chars}, FALSE) AS present
FROM (SELECT DISTINCT entity_id FROM {texts}) e CROSS JOIN (SELECT unnest(generate_series(0, {n} - 1)) AS idx) s
LEFT JOIN (SELECT entity_id, idx, {norm("coalesce(text, '')")} AS norm FROM {texts}) t ON t.entity_id = e.entity_id AND t.idx = s.idx"""


def classes(grid_name: str) -> str:
    return f"""
SELECT entity_id, presence, CASE
  WHEN NOT contains(presence, '1') THEN 'EMPTY' WHEN runs > 1 THEN 'ANOMALY'
  WHEN presence LIKE '0%1' THEN 'INTRODUCED' WHEN presence LIKE '1%0' THEN 'REMOVED' WHEN contains(presence, '0') THEN 'TRANSIENT'
  WHEN n_changes = 0 THEN 'STABLE' WHEN n_changes = 1 THEN 'SINGLE-CHANGE' ELSE 'MULTI-CHANGE' END AS class,
  CASE WHEN runs = 1 AND presence LIKE '0%1' THEN appears WHEN runs = 1 AND presence LIKE '1%0' THEN vanishes END AS interval,
  coalesce(changed, '') AS changed_intervals, n_changes FROM (
  SELECT entity_id, string_agg(CASE WHEN present THEN '1' ELSE '0' END, '' ORDER BY idx) AS presence,
    count(*) FILTER (present AND NOT was_present) AS runs, min(idx) FILTER (present AND NOT was_present) AS appears,
    min(idx) FILTER (was_present AND NOT present) AS vanishes,
    count(*) FILTER (present AND was_present AND norm <> was_norm) AS n_changes,
    string_agg(CAST(idx AS VARCHAR), ',' ORDER BY idx) FILTER (present AND was_present AND norm <> was_norm) AS changed FROM (
    SELECT *, lag(present, 1, FALSE) OVER w AS was_present, lag(norm) OVER w AS was_norm FROM {grid_name} WINDOW w AS (PARTITION BY entity_id ORDER BY idx))
  GROUP BY 1)"""


step("cust_grid", "cust_texts", grid("cust_texts", "(SELECT max(idx) + 1 FROM cust_texts)", 1))
step("cust_classes", "cust_grid", classes("cust_grid"))
step("turn_grid", "turns", grid("turns", "(SELECT max(idx) + 1 FROM turns)", 30))
step("turn_classes", "turn_grid", classes("turn_grid"))
step("doc_texts", "editions", f"""
SELECT entity_id, CASE WHEN snapshot = '{_CUR}' THEN 1 ELSE 0 END AS idx, {_STUBBED} AS text FROM editions""")
step("doc_grid", "doc_texts", grid("doc_texts", "2", 30))
step("doc_classes", "doc_grid", classes("doc_grid"))
step("buckets", "cust_texts", f"""
SELECT idx, count(*) AS n_entities, make_date((SELECT min(year(o_orderdate)) FROM orders) + {bd.YEARS_PER_SNAPSHOT} * idx, 1, 1) AS date FROM cust_texts GROUP BY 1""")

# Web pages as page records.
_H1 = f"regexp_replace(html, {lit(TITLE)}, chr(10) || '{bd.PAGE_KEYWORD} ' || regexp_extract(url, '/[a-z]{{2}}/(\\d+)', 1) || '. \\1' || chr(10), 'g')"
step("page_texts", "", f"""
SELECT regexp_extract(url, '^https?://[^/]+/([a-z]{{2}})/', 1) AS snapshot, page_id AS page,
  'SECTION ' || upper(regexp_extract(url, '^https?://[^/]*\\.([a-z])[a-z]*/', 1)) || ': web' || chr(10) || {plain(_H1)} AS text FROM pages""")
step("page_lines", "page_texts", f"""
SELECT snapshot, page, line_no, line, regexp_matches(line, '^SECTION\\s+[A-Z][0-9]?:') AS is_outer,
  NOT regexp_matches(line, '^SECTION\\s+[A-Z][0-9]?:') AND regexp_matches(line, '^Condition\\s+(\\d+[A-Z]{{0,3}}(?:\\.[A-Z])?)[.:]\\s+(.+)') AS is_head
FROM (SELECT snapshot, page, row_number() OVER (PARTITION BY snapshot, page ORDER BY raw_no) - 1 AS line_no, line FROM (
  SELECT snapshot, page, generate_subscripts(ls, 1) AS raw_no, {strip('unnest(ls)')} AS line FROM (
    SELECT snapshot, page, string_split(text, chr(10)) AS ls FROM page_texts
    JOIN (SELECT * FROM ({_values(list(bd.BODY_START.items()))}) AS b(lang, body_start)) ON lang = snapshot WHERE page >= body_start))
  WHERE NOT {boiler('line')})""")
step("marked", "page_lines", """
SELECT *, CAST(sum(CASE WHEN is_head THEN 1 ELSE 0 END) OVER w AS BIGINT) AS section_no,
  coalesce(last_value(CASE WHEN is_outer THEN regexp_extract(line, '^(SECTION\\s+[A-Z][0-9]?):', 1) END IGNORE NULLS) OVER w, '') AS outer_label
FROM page_lines WINDOW w AS (PARTITION BY snapshot ORDER BY page, line_no ROWS UNBOUNDED PRECEDING)""")
_HEAD = "'^Condition\\s+(\\d+[A-Z]{0,3}(?:\\.[A-Z])?)[.:]\\s+(.+)'"
step("heads", "marked", f"""
SELECT snapshot, section_no, regexp_extract(line, {_HEAD}, 1) AS entity_id, {strip(f"regexp_extract(line, {_HEAD}, 2)")} AS title,
  outer_label AS section, page AS page_start FROM marked WHERE is_head""")
step("placed", "marked heads", """
SELECT m.snapshot, m.section_no, h.entity_id, m.page, m.line_no, m.line FROM marked m
JOIN heads h USING (snapshot, section_no) WHERE NOT is_head AND NOT is_outer""")
step("page_sections", "heads placed", f"""
SELECT h.*, coalesce(n.last_page, page_start) AS page_end, coalesce(n.n_lines, 0) AS n_lines, coalesce(n.n_words, 0) AS n_words
FROM heads h LEFT JOIN (SELECT snapshot, section_no, max(page) AS last_page, count(*) AS n_lines, CAST(sum(len({words('line')})) AS BIGINT) AS n_words
  FROM placed GROUP BY 1, 2) n USING (snapshot, section_no)""")
step("page_entities", "page_sections", """
SELECT snapshot, entity_id, arg_min(title, section_no) AS title, arg_min(section, section_no) AS section, min(page_start) AS page_start,
  max(page_end) AS page_end, count(*) AS n_headings, CAST(sum(n_lines) AS BIGINT) AS n_lines, CAST(sum(n_words) AS BIGINT) AS n_words
FROM page_sections GROUP BY 1, 2""")
step("page_bodies", "placed", "SELECT snapshot, entity_id, string_agg(line, ' ' ORDER BY page, line_no) AS body FROM placed GROUP BY 1, 2")
step("page_words", "page_entities page_bodies", f"""
SELECT snapshot, entity_id, title, section, page_start, page_end, {words(_STUBBED)} AS ws
FROM page_entities LEFT JOIN page_bodies USING (snapshot, entity_id)""")

# Evaluation.
step("gold", "", """
SELECT CAST(item_id AS VARCHAR) AS query_id, CAST(doc_id AS VARCHAR) AS entity_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)""")
step("cases", "questions gold", f"""
SELECT query_id, CASE WHEN g.q IS NULL THEN 'refuse' ELSE 'answer' END AS expected,
  CASE WHEN g.q IS NOT NULL THEN string_split_regex(text, '\\s+')[2] END AS expect_contains,
  CASE WHEN g.q IS NOT NULL AND as_of > DATE '2021-01-01' THEN CASE WHEN as_of < DATE '2023-01-01' THEN '{_OLD}' ELSE '{_CUR}' END END AS expect_snapshot,
  CASE WHEN g.q IS NOT NULL AND is_broad THEN 'text-change' END AS expect_history
FROM questions LEFT JOIN (SELECT DISTINCT query_id AS q FROM gold) g ON g.q = query_id""")
_REFUSED = f"SELECT a.query_id, a.sub_no, min(n.distance) AS best_distance, coalesce(min(n.distance), 1e308) > {bd.DISTANCE_FLOOR} AS refused FROM asked a LEFT JOIN (SELECT * FROM nearest WHERE rank <= 10) n ON n.query_id = a.query_id AND n.sub_no = a.sub_no GROUP BY 1, 2"
step("refused", "asked nearest", _REFUSED)
step("results", "refused unioned chunks", f"""
SELECT r.query_id, r.refused, c.text AS answer FROM refused r
LEFT JOIN unioned u ON u.query_id = r.query_id AND u.rank = 1
LEFT JOIN chunks c ON c.snapshot = '{_CUR}' AND c.entity_id = u.entity_id AND c.chunk_index = u.chunk_index WHERE r.sub_no = 0""")
step("doc_view", "doc_resolved users", view("doc_resolved"))
step("doc_sides", "doc_resolved doc_line", sides("doc_resolved", "doc_line"))
step("cited_history", "citations doc_view questions", """
SELECT query_id, history_no, entity_id, kind, change_date, as_of FROM (
  SELECT c.query_id, q.is_broad, row_number() OVER (PARTITION BY c.query_id ORDER BY c.cite_no) AS history_no, c.entity_id, v.kind, v.change_date, v.as_of
  FROM citations c JOIN questions q USING (query_id) JOIN doc_view v ON v.entity_id = c.entity_id AND v.as_of = q.as_of)
WHERE history_no <= CASE WHEN is_broad THEN 8 ELSE 2 END""")
step("history", "cited_history doc_sides doc_line", f"""
SELECT h.query_id, h.entity_id, h.kind, CASE WHEN h.kind = 'text-change' THEN coalesce(s.change_date = h.change_date, FALSE)
  AND EXISTS (SELECT 1 FROM doc_line l WHERE l.entity_id = h.entity_id AND {long_date('l.start')} = h.change_date) END AS consistent
FROM cited_history h LEFT JOIN doc_sides s ON s.entity_id = h.entity_id AND s.as_of = h.as_of""")
step("graded", "cases results unioned served gold citations history", """
SELECT query_id, expected, refused, (expected = 'refuse') = refused AS decision_ok,
  CASE WHEN expected = 'answer' THEN rank IS NOT NULL END AS retrieval_hit, CASE WHEN expected = 'answer' THEN rank END AS rank,
  CASE WHEN expected = 'answer' THEN query_id IN (SELECT c.query_id FROM citations c JOIN gold USING (query_id, entity_id)) END AS citation_hit,
  CASE WHEN expect_contains IS NOT NULL THEN coalesce(contains(lower(answer), lower(expect_contains)), FALSE) END AS contains_ok,
  CASE WHEN expect_snapshot IS NOT NULL THEN coalesce(served_ok, FALSE) END AS snapshot_ok,
  CASE WHEN consistent = FALSE THEN FALSE WHEN expect_history IS NOT NULL THEN coalesce(kind_ok, FALSE) WHEN consistent THEN TRUE END AS history_ok
FROM cases JOIN results USING (query_id)
LEFT JOIN (SELECT u.query_id, min(u.rank) AS rank, bool_or(s.snapshot = c.expect_snapshot) AS served_ok
  FROM unioned u JOIN gold USING (query_id, entity_id) JOIN served s USING (query_id, entity_id) JOIN cases c USING (query_id) GROUP BY 1) f USING (query_id)
LEFT JOIN (SELECT h.query_id, bool_or(h.kind = c.expect_history) AS kind_ok FROM history h JOIN gold USING (query_id, entity_id) JOIN cases c USING (query_id) GROUP BY 1) k USING (query_id)
LEFT JOIN (SELECT query_id, bool_and(consistent) AS consistent FROM history GROUP BY 1) x USING (query_id)""")
step("surfaced", "nearest lexical hits unioned", """
SELECT DISTINCT 'vector' AS variant, query_id, entity_id FROM nearest WHERE sub_no = 0 AND rank <= 6
UNION ALL SELECT DISTINCT 'lexical', query_id, entity_id FROM lexical WHERE sub_no = 0 AND rank <= 6
UNION ALL SELECT DISTINCT 'served', query_id, entity_id FROM hits WHERE sub_no = 0
UNION ALL SELECT DISTINCT 'planned', query_id, entity_id FROM unioned
UNION ALL SELECT DISTINCT 'ceiling', query_id, entity_id FROM (SELECT query_id, sub_no, entity_id FROM nearest UNION ALL SELECT query_id, sub_no, entity_id FROM lexical) WHERE sub_no = 0""")


def core(surfaced: str, by: str) -> str:
    return f"""
SELECT v.{by}, g.query_id, count(*) AS n_core, count(s.entity_id) AS n_found,
  coalesce(string_agg(g.entity_id, ',' ORDER BY g.entity_id) FILTER (s.entity_id IS NULL), '') AS missing, coalesce(any_value(z.noise), 0) AS n_noise
FROM gold g CROSS JOIN (SELECT DISTINCT {by} FROM {surfaced}) v
LEFT JOIN {surfaced} s ON s.{by} = v.{by} AND s.query_id = g.query_id AND s.entity_id = g.entity_id
LEFT JOIN (SELECT {by}, query_id, count(*) AS noise FROM {surfaced} s WHERE NOT EXISTS (SELECT 1 FROM gold g WHERE g.query_id = s.query_id AND g.entity_id = s.entity_id)
  AND NOT EXISTS (SELECT 1 FROM unioned u JOIN demoted USING (entity_id) WHERE u.query_id = s.query_id AND u.entity_id = s.entity_id) GROUP BY 1, 2) z
  ON z.{by} = v.{by} AND z.query_id = g.query_id GROUP BY 1, 2"""


def totals(source: str, by: str) -> str:
    return f"""SELECT {by}, CAST(sum(n_found) AS BIGINT) AS found, CAST(sum(n_core) AS BIGINT) AS core, round(sum(n_found) / sum(n_core), 4) AS recall,
  count(*) FILTER (n_noise > 0) AS noisy_queries, CAST(sum(n_noise) AS BIGINT) AS noise FROM {source} GROUP BY 1"""


step("core_rows", "surfaced gold unioned demoted", core("surfaced", "variant"))
step("pass_surfaced", "citations", """
SELECT DISTINCT p + 1 AS pass, query_id, entity_id FROM (
  SELECT query_id, entity_id, (CAST(pages AS BIGINT) - 1) // 3 AS ob FROM citations), (SELECT unnest(generate_series(0, (SELECT max((CAST(pages AS BIGINT) - 1) // 3) FROM citations))) AS p) WHERE p >= ob""")
step("pass_rows", "pass_surfaced gold unioned demoted", core("pass_surfaced", "pass"))


def sql() -> dict[str, str]:
    out: dict[str, str] = {}

    def add(name: str, needs: str, select: str) -> None:
        out[name] = with_steps(needs, select)

    add("page_counts", "page_texts", "SELECT snapshot, count(*) AS n_pages, count(*) FILTER (trim(text) = '') AS n_empty FROM page_texts GROUP BY 1")
    add("snapshot_dates", "", """
SELECT make_date(CAST(y AS BIGINT), CAST(m AS BIGINT), CASE WHEN d = '' THEN 1 ELSE CAST(d AS BIGINT) END) AS date, count(*) AS n_files FROM (
  SELECT regexp_extract(f, '(\\d{4})-(\\d{2})', 1) AS y, regexp_extract(f, '(\\d{4})-(\\d{2})', 2) AS m, regexp_extract(f, '\\d{4}-\\d{2}-(\\d{2})', 1) AS d FROM (
    SELECT 'orders-' || CASE WHEN o_orderpriority = '1-URGENT' THEN strftime(o_orderdate, '%Y-%m') ELSE strftime(o_orderdate, '%Y-%m-%d') END || '.txt' AS f FROM orders)) GROUP BY 1""")
    add("snapshot_registry", "buckets", "SELECT idx, n_entities, date, CAST(date AS VARCHAR) AS snapshot, date = (SELECT max(date) FROM buckets) AS is_current FROM buckets")
    add("published_pages", "page_texts", """
SELECT snapshot, count(*) AS n_pages, count(*) FILTER (trim(text) = '') AS n_empty, CAST(sum(length(text)) AS BIGINT) AS n_chars,
  (SELECT count(*) FROM page_texts WHERE snapshot IN ('de', 'en')) AS last_n_rows, (SELECT count(*) FROM page_texts WHERE snapshot IN ('de', 'en') AND trim(text) = '') AS last_n_empty,
  (SELECT CAST(sum(length(text)) AS BIGINT) FROM page_texts WHERE snapshot IN ('de', 'en')) AS last_n_chars FROM page_texts GROUP BY 1""")
    add("dated_pages", "page_texts", """
SELECT CASE snapshot WHEN 'es' THEN DATE '2022-01-01' ELSE DATE '2023-11-30' END AS date, count(*) AS n_pages, CAST(sum(page) AS BIGINT) AS pages,
  CAST(sum(length('text of ' || text)) AS BIGINT) AS n_chars FROM page_texts WHERE snapshot IN ('es', 'fr') GROUP BY 1""")
    add("chunk_metadata", "chunks", f"""
SELECT chunk_id, 'edition-' || snapshot AS source, CASE snapshot WHEN '{_OLD}' THEN 'first edition' ELSE 'second edition' END AS doc_title, CAST(snapshot AS DATE) AS version_date,
  CASE snapshot WHEN '{_OLD}' THEN 'archive' ELSE 'publisher' END AS authority, 'https://example.org/' || snapshot AS url, chunk_index, n_words FROM chunks""")
    add("fetch_by_ids", "hits chunks", f"""
SELECT chunk_id, n_words, text FROM chunks WHERE chunk_id IN (SELECT '{_CUR}__' || entity_id || '_' || chunk_index FROM hits)""")
    add("fetch_snapshot", "chunks", f"SELECT chunk_id, entity_id, chunk_index, n_words FROM chunks WHERE snapshot = '{_OLD}'")

    add("boilerplate_filter", "", f"""
SELECT doc_id, line_no, line FROM (SELECT doc_id, generate_subscripts(ls, 1) - 1 AS line_no, {strip('unnest(ls)')} AS line
  FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)) WHERE NOT {boiler('line')}""")
    add("page_headings", "heads", "FROM heads")
    add("sectionise_pages", "page_sections", "FROM page_sections")
    add("merge_sections", "page_entities", "FROM page_entities")
    add("section_bodies", "page_bodies", "SELECT snapshot, entity_id, length(body) AS n_chars, md5(body) AS digest FROM page_bodies")
    add("page_chunks", "page_words", windows("page_words", "snapshot, entity_id, title, section, page_start, page_end"))
    add("chunk_windows", "chunks", "FROM chunks")
    add("chunk_stats", "chunks", """
SELECT snapshot, count(DISTINCT entity_id) AS n_entities, count(*) AS n_chunks, min(n_words) AS min_words, max(n_words) AS max_words,
  CAST(sum(n_words) // count(*) AS BIGINT) AS mean_words, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM chunks GROUP BY 1""")
    out["published_chunks"] = out["chunk_stats"]
    add("entity_sizes", "chunks", "SELECT snapshot, entity_id, count(*) AS n_chunks, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM chunks GROUP BY 1, 2")
    add("reconstruct_roundtrip", "doc_words", "SELECT snapshot, entity_id, md5(array_to_string(ws, ' ')) AS digest, TRUE AS same FROM doc_words")
    add("tokenise", "", f"SELECT doc_id, len(t) AS n_tokens, md5(array_to_string(t, ' ')) AS digest FROM (SELECT doc_id, {tokens('text')} AS t FROM documents)")
    add("normalise_text", "", f"SELECT doc_id, length(t) AS n_chars, md5(t) AS digest FROM (SELECT doc_id, {norm('text')} AS t FROM documents)")

    add("natural_ids", "page_texts", """
SELECT DISTINCT e AS entity_id, CASE WHEN regexp_extract(e, '^\\d+') = '' THEN 999 ELSE CAST(regexp_extract(e, '^\\d+') AS BIGINT) END AS id_number
FROM (SELECT regexp_extract(text, '\\nCondition ([^\\s]+)\\. ', 1) AS e FROM page_texts)""")
    cited = "'Condition ' || regexp_extract(c_name, '0*(\\d+)$', 1) || substr(c_mktsegment, 1, 2) || '.B - title'"
    add("bare_ids", "", f"SELECT c_custkey, {bare(cited)} AS bare, {bare('c_name')} AS raw FROM customer")
    add("long_dates", "", f"SELECT o_orderkey, {long_date('o_orderdate')} AS day, CAST(o_orderdate AS DATE) < DATE '1998-01-01' AS is_past FROM orders")

    add("inverted_index", "postings", "SELECT entity_id, chunk_index, len_body, len_title, term, CAST(tf_body AS BIGINT) AS tf_body, CAST(tf_title AS BIGINT) AS tf_title FROM postings")
    add("idf_table", "idf", "SELECT term, df, round(idf, 6) AS idf FROM idf")
    add("alias_expand", "query_terms", "FROM query_terms")
    add("phrase_matches", "", r"""
SELECT b.item_id, p.phrase FROM benchmark b, (
  SELECT DISTINCT phrase FROM (
    SELECT substr(array_to_string(string_split_regex(text, '[ \n]+')[1:2], ' '), 1, 12) AS phrase FROM documents UNION ALL SELECT lower(substr(r_name, 2, 2)) FROM region)
  WHERE phrase <> '') p WHERE contains(b.text, p.phrase)""")
    add("bm25_top10", "lexical", "FROM lexical WHERE rank <= 10")
    add("bm25_top40", "lexical", "FROM lexical")
    top = lambda w: ranked(scored(w, "(SELECT * FROM query_terms WHERE sub_no = 0)"), "score DESC, entity_id, chunk_index", 1, "entity_id, score")
    add("bm25_title_boost", "query_terms idf postings sizes", f"""
SELECT p.query_id, p.entity_id AS entity_plain, p.score AS score_plain, b.entity_id AS entity_boosted, b.score AS score_boosted
FROM ({top(1)}) p JOIN ({top(8)}) b USING (query_id)""")
    add("chunk_vectors", "chunk_vectors", """
SELECT entity_id, chunk_index, array_to_string(list_transform(v, lambda x: CAST(CAST(x AS BIGINT) AS VARCHAR)), ',') AS vector FROM chunk_vectors""")
    add("text_knn_top40", "nearest", "SELECT query_id, sub_no, rank, entity_id, chunk_index, round(distance, 6) AS distance FROM nearest")
    add("knn_top10", "", """
SELECT query_id, rank, vec_id, distance FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM (
    SELECT CAST(q.vec_id AS VARCHAR) AS query_id, c.vec_id,
      round(list_sum(list_transform(list_zip(CAST(q.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 4) AS distance
    FROM embeddings q JOIN benchmark ON item_id = q.vec_id, embeddings c)) WHERE rank <= 10""")
    add("knn_approx", "", inverted_lists())
    add("distance_backstop", "refused", "SELECT query_id, sub_no, round(best_distance, 6) AS best_distance, refused FROM refused")

    add("rrf_fuse", "fused", "SELECT query_id, sub_no, rank, entity_id, chunk_index, round(score, 9) AS score FROM fused")
    add("hybrid_top6_demoted", "hits", "SELECT query_id, sub_no, rank, entity_id, chunk_index, round(score, 9) AS score, demoted, round(distance, 6) AS distance FROM hits")
    add("distance_labels", "hits", "SELECT query_id, sub_no, rank, coalesce(format('{:.3f}', distance), 'kw') AS label FROM hits")
    add("candidate_landscape", "nearest lexical", """
SELECT query_id, sub_no, rank, entity_id FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id, sub_no ORDER BY seen) AS rank FROM (
    SELECT query_id, sub_no, entity_id, min(seen) AS seen FROM (
      SELECT query_id, sub_no, entity_id, rank AS seen FROM nearest UNION ALL SELECT query_id, sub_no, entity_id, 1000 + rank FROM lexical)
    GROUP BY 1, 2, 3)) WHERE rank <= 25""")
    add("hint_subqueries", "hints", "FROM hints")
    add("subquery_assembly", "asked", "FROM asked")
    add("round_robin_union", "unioned", "SELECT query_id, rank, entity_id, chunk_index, round(distance, 6) AS distance FROM unioned")
    add("union_truncated", "hits", """
SELECT query_id, count(*) AS n_distinct, count(*) > 12 AS truncated FROM (SELECT DISTINCT query_id, entity_id, chunk_index FROM hits) GROUP BY 1""")
    add("entities_first_seen", "hits", """
SELECT query_id, sub_no, entity_id, min(rank) AS first_rank, row_number() OVER (PARTITION BY query_id, sub_no ORDER BY min(rank)) AS entity_rank FROM hits GROUP BY 1, 2, 3""")

    add("chunk_index_sets", "chunks", "SELECT snapshot, entity_id, count(*) AS n_chunks, min(chunk_index) AS first_index, max(chunk_index) AS last_index FROM chunks GROUP BY 1, 2")
    add("expand_context", "wanted", "FROM wanted")
    add("expand_neighbours", "unioned served entity_rank chunk_counts chunks", wanted(1, 1, 2))
    add("reading_order", "ordered", "SELECT query_id, place, chunk_id, text FROM ordered")
    add("context_blocks", "blocks", "FROM blocks")
    add("grounding_record", "questions fact_texts covered blocks", f"""
SELECT query_id, as_of, concat_ws(chr(10) || chr(10), 'Current snapshot: {_CUR}.', 'As of: ' || {long_date('as_of')}, {_SCOPE},
  'Facts:' || chr(10) || facts, 'Question: ' || text, 'Extracts:' || chr(10) || chr(10) || context) AS record
FROM questions LEFT JOIN fact_texts USING (query_id) LEFT JOIN covered USING (query_id)
LEFT JOIN (SELECT query_id, string_agg(block, chr(10) || chr(10) ORDER BY block_no) AS context FROM blocks GROUP BY 1) USING (query_id)""")
    add("retrieved_sources", "unioned chunks served", f"""
SELECT u.query_id, u.rank, u.entity_id, c.title, c.page_start || '-' || c.page_end AS pages, round(u.distance, 3) AS distance,
  coalesce(format('{{:.3f}}', u.distance), 'kw') AS distance_label, s.snapshot AS served
FROM unioned u JOIN chunks c ON c.snapshot = '{_CUR}' AND c.entity_id = u.entity_id AND c.chunk_index = u.chunk_index
LEFT JOIN served s ON s.query_id = u.query_id AND s.entity_id = u.entity_id""")
    add("citation_flatten", "citations", "FROM citations")
    add("citation_history", "cited_history", "FROM cited_history")

    add("timeline_segments", "order_line", 'SELECT entity_id, seg_idx, start, "end", snapshot, note, n_segments, introduced FROM order_line')
    add("segment_gap_check", "order_line", """
SELECT entity_id, count(*) AS n_segments, count(*) FILTER ("end" < following) AS n_gaps, count(*) FILTER (following IS NOT NULL AND ("end" IS NULL OR "end" > following)) AS n_overlaps,
  count(*) FILTER ("end" <= start) AS n_empty,
  count(*) FILTER ("end" <= start OR "end" < following OR (following IS NOT NULL AND ("end" IS NULL OR "end" > following))) = 0 AS contiguous
FROM (SELECT *, lead(start) OVER (PARTITION BY entity_id ORDER BY start, "end" NULLS LAST) AS following FROM order_line) GROUP BY 1""")
    add("segment_asof", "segs", 'SELECT entity_id, as_of, state, n_probes, seg_idx, snapshot, start, "end" FROM segs')
    STEPS["shipped"] = (["order_line"], "SELECT CAST(o_custkey AS VARCHAR) AS entity_id, CAST(l_shipdate AS DATE) AS as_of FROM lineitem JOIN orders ON o_orderkey = l_orderkey")
    STEPS["ship_segs"] = (["shipped", "order_line"], resolved("shipped", "order_line"))
    add("shipment_asof", "ship_segs", "SELECT entity_id, as_of, n_probes, state, seg_idx, snapshot FROM ship_segs")
    add("existence_asof", "probes users", "SELECT p.entity_id, p.as_of, u.introduced, p.as_of >= u.introduced AS existed FROM probes p LEFT JOIN users u USING (entity_id)")
    add("served_snapshot", "segs", f"SELECT entity_id, as_of, {_SERVED.format(current=lit('O'))} AS served FROM segs")
    add("clamped_segment", "segs", f"SELECT entity_id, as_of, {_IDX} AS served_idx FROM segs")
    add("bracketed_change", "segs", f"SELECT entity_id, as_of, {_CHANGE_IDX} AS change_idx, {_CHANGE_DATE} AS change_date FROM segs")
    add("existence_facts", "probes users", f"""
SELECT p.entity_id, p.as_of, p.entity_id || ' (' || title || ') came in on ' || {long_date('introduced')} || '; on ' || {long_date('as_of')} || ' ' ||
  CASE WHEN as_of >= introduced THEN 'it was in force with its current text' ELSE 'it did not exist yet' END || '.' AS fact FROM probes p JOIN users u USING (entity_id)""")
    add("change_facts", "segs order_dates", change_facts("segs", "order_dates"))
    add("citation_notes", "segs users", notes("segs"))
    add("scope_notes", "questions covered", f"SELECT query_id, as_of, {_SCOPE} AS note FROM questions LEFT JOIN covered USING (query_id)")
    add("timeline_markers", "turn_markers users", f"""
SELECT * FROM turn_markers UNION ALL SELECT entity_id, 0, 'earlier', 'did not exist', 'not held' FROM users
UNION ALL SELECT entity_id, 1, {long_date('introduced')}, 'introduced', title FROM users""")
    add("history_view", "segs users", view("segs"))
    add("version_compare", "turn_sides", "FROM turn_sides")
    add("version_texts", "turn_sides turns", """
SELECT s.entity_id, s.as_of, s.change_idx, s.old_snapshot, s.new_snapshot, o.text AS old_text, n.text AS new_text FROM turn_sides s
LEFT JOIN turns o ON o.entity_id = s.entity_id AND CAST(o.idx AS VARCHAR) = s.old_snapshot
LEFT JOIN turns n ON n.entity_id = s.entity_id AND CAST(n.idx AS VARCHAR) = s.new_snapshot""")
    add("version_comparables", "turn_line", f"""
SELECT entity_id, max(title) AS title, count(*) AS n_changes, {long_date('max(start)')} AS last_change, CAST(entity_id AS BIGINT) AS id_number
FROM turn_line WHERE seg_idx > 0 GROUP BY 1""")
    add("history_markers", "turn_view turn_markers users", f"""
SELECT v.entity_id, v.as_of, v.kind, v.change_date, m.markers FROM turn_view v LEFT JOIN (
  SELECT entity_id, 'text-change' AS kind, string_agg(concat_ws(': ', date, label, note), chr(10) ORDER BY marker_no) AS markers FROM turn_markers GROUP BY 1
  UNION ALL SELECT entity_id, 'introduced', 'earlier: did not exist: not held' || chr(10) || {long_date('introduced')} || ': introduced: ' || title FROM users) m
ON m.entity_id = v.entity_id AND m.kind = v.kind""")
    add("version_compare_latest", "turn_line", f"""
SELECT n.entity_id, n.seg_idx AS change_idx, {long_date('n.start')} AS change_date, n.note, o.snapshot AS old_snapshot,
  {long_date('o.start')} || ' - ' || {long_date('n.start')} AS old_in_force, n.snapshot AS new_snapshot, 'from ' || {long_date('n.start')} || ' (current)' AS new_in_force
FROM turn_line n JOIN turn_line o ON o.entity_id = n.entity_id AND o.seg_idx = n.seg_idx - 1 WHERE n."end" IS NULL""")
    add("history_invariant", "invariant", "FROM invariant")
    add("history_word_diff", "turn_view turn_sides diff_shown", """
SELECT v.*, d.diff, d.truncated FROM turn_view v LEFT JOIN turn_sides s ON s.entity_id = v.entity_id AND s.as_of = v.as_of
LEFT JOIN diff_shown d ON d.entity_id = s.entity_id AND CAST(d.idx AS VARCHAR) = s.new_snapshot AND CAST(d.idx - 1 AS VARCHAR) = s.old_snapshot""")
    add("word_diff", "diff_shown", "FROM diff_shown")
    add("side_by_side", "pairs diff_sides", "SELECT p.entity_id, p.idx, coalesce(old_side, '') AS old_side, coalesce(new_side, '') AS new_side FROM pairs p LEFT JOIN diff_sides USING (entity_id, idx)")
    add("text_similarity", "pairs", f"""
SELECT * FROM (WITH {alignment(f"SELECT entity_id, idx, side, generate_subscripts(ws, 1) - 1 AS pos, unnest(ws) AS word FROM (SELECT entity_id, idx, 0 AS side, {words('old')} AS ws FROM pairs WHERE {norm('old')} <> {norm('new')} UNION ALL SELECT entity_id, idx, 1, {words('new')} FROM pairs WHERE {norm('old')} <> {norm('new')})", "entity_id, idx", _WAYS)},
held AS (SELECT entity_id, idx, sum(length({norm('word')})) AS n FROM aligned WHERE partner IS NOT NULL AND side = 0 GROUP BY 1, 2),
rest AS (SELECT entity_id, idx, gap AS g, side, string_split(string_agg({norm('word')}, '' ORDER BY pos), '') AS ls FROM aligned WHERE partner IS NULL GROUP BY 1, 2, 3, 4),
letters AS (SELECT * FROM (SELECT entity_id, idx, g, side, generate_subscripts(ls, 1) - 1 AS pos, unnest(ls) AS word FROM rest) WHERE word <> ''),
inner_ones AS (
  WITH {alignment("SELECT * FROM letters", "entity_id, idx, g", (3, "start", "end"))}
  SELECT entity_id, idx, count(*) AS n FROM aligned WHERE partner IS NOT NULL AND side = 0 GROUP BY 1, 2),
matched AS (SELECT entity_id, idx, sum(n) AS m FROM (SELECT * FROM held UNION ALL SELECT * FROM inner_ones) GROUP BY 1, 2)
SELECT entity_id, idx, round(r, 3) AS similarity, r >= 0.97 AS small_edit FROM (
  SELECT p.entity_id, p.idx, 2 * coalesce(m, 0) / CAST(length({norm('old')}) + length({norm('new')}) AS DOUBLE) AS r
  FROM pairs p LEFT JOIN matched USING (entity_id, idx) WHERE {norm('old')} <> {norm('new')}))""")

    add("presence_grid", "cust_grid", "SELECT entity_id, idx, present FROM cust_grid")
    add("turn_presence", "turns", f"SELECT entity_id, idx, coalesce(length({norm('text')}) >= 30, FALSE) AS present FROM turns")
    add("change_classes", "cust_classes", "FROM cust_classes")
    add("incremental_classes", "cust_classes", "FROM cust_classes")
    add("turn_classes", "turn_classes", "SELECT entity_id, presence, class, n_changes FROM turn_classes")
    add("change_intervals", "doc_classes", "SELECT entity_id, presence, class, n_changes FROM doc_classes")
    add("class_counts", "cust_classes", "SELECT class, count(*) AS n_entities FROM cust_classes GROUP BY 1")
    add("interval_labels", "buckets", """
SELECT idx + 1 AS interval, 'I' || (idx + 1) || ' = ' || date || ' -> ' || following AS label
FROM (SELECT idx, date, lead(date) OVER (ORDER BY idx) AS following FROM buckets) WHERE following IS NOT NULL""")
    add("change_report", "cust_classes cust_texts", """
SELECT class, entity_id, title, presence, interval, CASE WHEN changed_intervals = '' THEN '' ELSE 'I' || replace(changed_intervals, ',', ', I') END AS changed_in,
  n_changes, CAST(entity_id AS BIGINT) AS id_number
FROM cust_classes JOIN (SELECT entity_id, 'status ' || arg_max(text, idx) AS title FROM cust_texts GROUP BY 1) USING (entity_id)""")
    def shown_changes(changed: str, texts: str, label: str) -> str:
        """Lines of the changed intervals (``entity_id, interval``) with label, similarity and the mark of small edits."""
        near = f"round(CASE WHEN greatest(length({norm('o.text')}), length({norm('n.text')})) = 0 THEN 1.0 ELSE 1 - levenshtein({norm('o.text')}, {norm('n.text')}) / greatest(length({norm('o.text')}), length({norm('n.text')})) END, 4)"
        return f"""
SELECT entity_id, string_agg(concat_ws(' ', label, format('{{:.4f}}', s), CAST(s >= 0.97 AS VARCHAR)), '; ' ORDER BY interval) AS changes FROM (
  SELECT c.entity_id, c.interval, {label} AS label, {near} AS s FROM ({changed}) c
  JOIN {texts} n ON n.entity_id = c.entity_id AND n.idx = c.interval JOIN {texts} o ON o.entity_id = c.entity_id AND o.idx = c.interval - 1) GROUP BY 1"""

    def shown_chars(texts: str) -> str:
        return f"""
SELECT entity_id, array_to_string(list_transform(range(0, (SELECT max(idx) + 1 FROM {texts})), lambda i: CAST(coalesce(m[i], 0) AS VARCHAR)), ',') AS chars
FROM (SELECT entity_id, map_from_entries(list((CAST(idx AS BIGINT), length({norm('text')})))) AS m FROM {texts} GROUP BY 1)"""

    turn_changes = f"SELECT entity_id, idx AS interval FROM pairs WHERE length({norm('old')}) >= 30 AND length({norm('new')}) >= 30 AND {norm('old')} <> {norm('new')}"
    add("change_details", "turns pairs turn_classes", f"""
SELECT t.entity_id, t.class, c.chars, coalesce(x.changes, '') AS changes FROM turn_classes t JOIN ({shown_chars("turns")}) c USING (entity_id)
LEFT JOIN ({shown_changes(turn_changes, "turns", "'I' || c.interval || ' = turn ' || (c.interval - 1) || ' -> turn ' || c.interval")}) x USING (entity_id)""")
    STEPS["labels_of"] = (["buckets"], """
SELECT idx + 1 AS interval, 'I' || (idx + 1) || ' = ' || date || ' -> ' || following AS label
FROM (SELECT idx, date, lead(date) OVER (ORDER BY idx) AS following FROM buckets) WHERE following IS NOT NULL""")
    cust_changes = "SELECT entity_id, CAST(unnest(string_split(changed_intervals, ',')) AS BIGINT) AS interval FROM cust_classes WHERE changed_intervals <> ''"
    add("published_report", "cust_classes cust_texts labels_of", f"""
SELECT class, entity_id, title, presence, interval, CASE WHEN changed_intervals = '' THEN '' ELSE 'I' || replace(changed_intervals, ',', ', I') END AS changed_in,
  n_changes, chars, coalesce(changes, '') AS changes
FROM cust_classes JOIN (SELECT entity_id, 'status ' || arg_max(text, idx) AS title FROM cust_texts GROUP BY 1) USING (entity_id)
JOIN ({shown_chars("cust_texts")}) USING (entity_id)
LEFT JOIN ({shown_changes(cust_changes, "cust_texts", "(SELECT label FROM labels_of l WHERE l.interval = c.interval)")}) USING (entity_id)
WHERE class IN ('SINGLE-CHANGE', 'INTRODUCED')""")
    add("change_candidates", "cust_classes cust_texts", f"""
SELECT entity_id, changed_intervals, similarity FROM cust_classes JOIN (
  SELECT n.entity_id, min(round(1 - levenshtein({norm('o.text')}, {norm('n.text')}) / greatest(length({norm('o.text')}), length({norm('n.text')})), 4)) AS similarity
  FROM cust_texts n JOIN cust_texts o ON o.entity_id = n.entity_id AND o.idx = n.idx - 1 GROUP BY 1) USING (entity_id)
WHERE class = 'SINGLE-CHANGE' ORDER BY similarity, CAST(entity_id AS BIGINT), entity_id LIMIT 12""")
    add("mapped_selfcheck", "users cust_classes", """
SELECT m.entity_id, mapped_as, coalesce(class, '?') AS detected FROM (
  SELECT number AS entity_id, 'existence' AS mapped_as FROM users UNION ALL SELECT entity_id, 'text-change' FROM users) m LEFT JOIN cust_classes USING (entity_id)""")
    add("side_texts", "pairs", f"SELECT entity_id, idx, md5(array_to_string({words('old')}, ' ')) AS old_text, md5(array_to_string({words('new')}, ' ')) AS new_text FROM pairs")
    add("edit_similarity", "pairs", f"""
SELECT entity_id, idx, o <> n AS changed, round(CASE WHEN greatest(length(o), length(n)) = 0 THEN 1.0 ELSE 1 - levenshtein(o, n) / greatest(length(o), length(n)) END, 4) AS edit_similarity
FROM (SELECT entity_id, idx, {norm('old')} AS o, {norm('new')} AS n FROM pairs)""")
    add("word_changes", "pairs", f"""
SELECT entity_id, idx, CAST(sum(greatest(net, 0)) AS BIGINT) AS added_words, CAST(sum(greatest(-net, 0)) AS BIGINT) AS removed_words FROM (
  SELECT entity_id, idx, word, sum(n) AS net FROM (
    SELECT entity_id, idx, unnest({words('old')}) AS word, -1 AS n FROM pairs UNION ALL SELECT entity_id, idx, unnest({words('new')}), 1 FROM pairs)
  GROUP BY 1, 2, 3) GROUP BY 1, 2""")

    add("gold_passages", "gold", "FROM gold")
    add("graded_cases", "graded", "FROM graded")
    add("recall_at_k", "graded", """
SELECT count(*) AS n_answer, count(*) FILTER (retrieval_hit) AS n_hit, count(*) FILTER (rank <= 1) AS recall_1, count(*) FILTER (rank <= 3) AS recall_3,
  count(*) FILTER (rank <= 6) AS recall_6, round(avg(rank), 2) AS mean_rank FROM graded WHERE expected = 'answer'""")
    share = lambda c: f"count(*) FILTER ({c}) || '/' || count({c}) AS {c}"
    add("eval_summary", "graded", "SELECT count(*) AS n_cases, " + ", ".join(map(share, ["decision_ok", "retrieval_hit", "citation_hit", "contains_ok", "snapshot_ok", "history_ok"])) + " FROM graded")
    add("decision_lists", "graded", """
SELECT query_id, CASE WHEN expected = 'answer' THEN 'false refusal' WHEN refused THEN 'correct refusal' ELSE 'false answer' END AS outcome
FROM graded WHERE refused OR expected = 'refuse'""")
    add("core_recall_noise", "core_rows", "FROM core_rows")
    add("variant_totals", "core_rows", totals("core_rows", "variant"))
    add("variant_compare", "core_rows", """
SELECT query_id, max(n_found) FILTER (variant = 'served') AS served_found, max(n_noise) FILTER (variant = 'served') AS served_noise,
  max(n_found) FILTER (variant = 'planned') AS planned_found, max(n_noise) FILTER (variant = 'planned') AS planned_noise FROM core_rows GROUP BY 1""")
    out["published_run"] = out["eval_summary"].replace("SELECT count(*) AS n_cases,", "SELECT count(*) AS n_rows, count(*) FILTER (decision_ok) AS n_right, count(*) AS n_cases,")
    add("cited_passes", "pass_rows refused", f"""
SELECT * FROM ({totals("pass_rows", "pass")}) JOIN (
  SELECT pass, count(*) AS asked, count(*) FILTER (coalesce(best_distance, 1e308) > {bd.DISTANCE_FLOOR} - 0.02 * (pass - 1)) AS refused
  FROM refused, (SELECT DISTINCT pass FROM pass_rows) WHERE sub_no = 0 GROUP BY 1) USING (pass)""")
    add("entity_count", "chunks", f"SELECT count(DISTINCT entity_id) AS n_entities FROM chunks WHERE snapshot = '{_CUR}'")
    return out

"""The engine's computations in DuckDB SQL, as chains of common table expressions."""

from __future__ import annotations

from silt.functions import text as T
from silt.operators import render as R
from silt.operators import stages as S

# RE2 spellings of the engine's character classes.
SPACE = r"[\x09-\x0D\x{85}\p{Z}]"
SOLID = r"[^\x09-\x0D\x{85}\p{Z}]"
ALNUM = r"[\p{L}\p{N}]"
NOT_ALNUM = r"[^\p{L}\p{N}]"
NOT_WORD = r"[^\p{L}\p{N}_]"
CONTROL = r"[\x00-\x08\x0A-\x0C\x0E-\x1F\x7F-\x{9F}]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def q(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("'", "''") + "'"


def like(column: str, pattern: str) -> str:
    return f"regexp_matches({column}, {q(pattern)})"


def sub(column: str, pattern: str, by: str = "") -> str:
    return f"regexp_replace({column}, {q(pattern)}, {q(by)}, 'g')"


def escaped(characters: str) -> str:
    return "".join(f"\\{c}" if c.isascii() and not c.isalnum() else c for c in characters)


# -- lines -----------------------------------------------------------------------------


def trim(x: str) -> str:
    return sub(x, rf"(?s)\A{SPACE}+|{SPACE}+\z")


def low(x: str) -> str:
    return f"translate({x}, '{UPPER}', '{LOWER}')"


def blank(x: str) -> str:
    return like(x, rf"\A{SPACE}*\z")


def strip_escapes(x: str) -> str:
    return sub(sub(x, r"(?s)\x1b(?:\[[^@-~]*(?:[@-~]|\z)|\].*?(?:\x07|\x1b\\|\z)|[^\[\]]|\z)"), CONTROL)


def overwrite(x: str) -> str:
    return f"list_reduce(string_split({x}, chr(13)), lambda a, b: b || substr(a, length(b) + 1))"


def clean_line(x: str) -> str:
    return f"CASE WHEN {like(x, '[' + chr(92) + 'x1b' + chr(92) + 'r]')} THEN {overwrite(strip_escapes(x))} ELSE {x} END"


def decoration(x: str) -> str:
    word = rf"(?i)\A{NOT_ALNUM}*(?:(?:{'|'.join(T.DECORATION_WORDS)})|[0-9](?:[0-9.]*[0-9])?)?{NOT_ALNUM}*\z"
    return f"len(list_filter(regexp_split_to_array({x}, {q(SPACE + '+')}), lambda w: w <> '' AND NOT {like('w', word)})) = 0"


def progress(x: str) -> str:
    t = trim(x)
    shape = r"(?s)\A([^%]*?)[0-9.]+%(.*)\z"
    part = lambda n: f"regexp_extract({t}, {q(shape)}, {n})"
    drawn = f"length({sub(t, '[^' + escaped(T.BAR_CHARACTERS) + ']')})"
    verb = like(t, rf"(?s)\A({'|'.join(T.PROGRESS_VERBS)}) .")
    spinner = like(t, rf"\A[{T.SPINNERS}]")
    return f"({t} <> '' AND ({verb} OR ({like(t, shape)} AND {decoration(part(1))} AND {decoration(part(2))}) OR ({drawn} >= {T.BAR_LEAST} AND {drawn} * 4 >= length({t}) * 3) OR {spinner}))"


def _reports(x: str, words: list[str]) -> str:
    w = "|".join(words)
    return f"({like(x, rf'\A{SPACE}*({w})({NOT_WORD}|\z)')} OR {like(x, rf'(\A|{NOT_ALNUM})({w})[:\[(]')} OR {like(x, rf'[0-9]{SPACE}+({w})')})"


def failing(x: str) -> str:
    y = low(x)
    phrases = " OR ".join(f"contains({y}, {q(p)})" for p in T.FAILURE_PHRASES)
    return f"({phrases} OR {like(y, rf'(?s)\A{SPACE}*{SOLID}*(error|exception){SOLID}*:({SPACE}|\z)')} OR {_reports(y, T.FAILURE_WORDS)})"


def testing(x: str) -> str:
    y = low(x)
    return f"({like(y, rf'(\A|{NOT_WORD})({'|'.join(T.TEST_FAILURE_WORDS)})({NOT_WORD}|\z)')} AND contains({y}, 'test'))"


def warning(x: str) -> str:
    return _reports(low(x), T.WARNING_WORDS)


def content(x: str) -> str:
    return like(x, ALNUM)


def tokens(x: str) -> str:
    runs = f"regexp_extract_all({x}, {q('(' + ALNUM + '+)')}, 1)"
    return f"(coalesce(list_sum(list_transform({runs}, lambda r: (length(r) + {T.RUN_PER_TOKEN - 1}) // {T.RUN_PER_TOKEN})), 0) + length({sub(x, '[^' + escaped(T.SPLITTERS) + ']')}))::BIGINT"


# -- streams ---------------------------------------------------------------------------

EVENTS = """ev AS (SELECT user_id, ts, event_id, CASE
    WHEN event_type = 'error' THEN CASE WHEN event_id % 20 = 0 THEN 'error: request ' || k || ' rejected' ELSE 'retrying request' END
    WHEN event_type = 'signup' THEN 'warning: legacy signup form'
    WHEN event_type = 'click' THEN '   Compiling page_' || k || ' v1'
    WHEN event_type = 'view' THEN 'checked item ' || k ELSE '' END AS line
  FROM (SELECT *, json_extract_string(props, '$.k') AS k FROM events)),
streams AS (SELECT user_id AS run_id, CASE WHEN user_id % 2 = 1 THEN 'stderr' ELSE 'stdout' END AS stream,
    string_agg(line, chr(10) ORDER BY ts, event_id) AS raw, (user_id % 3)::INT AS exit_code FROM ev GROUP BY user_id)"""

CONVERSATIONS = """streams AS (SELECT conv_id AS run_id, 'stdout' AS stream,
    string_agg(coalesce(text, ''), chr(10) || chr(10) ORDER BY turn) AS raw, 1::INT AS exit_code FROM conversations GROUP BY conv_id)"""

DOCUMENTS = "streams AS (SELECT doc_id AS run_id, 'stdout' AS stream, text AS raw, 0::INT AS exit_code FROM documents)"


def lines() -> str:
    return r"""parts AS (SELECT run_id, stream, exit_code, string_split(coalesce(raw, ''), chr(10)) AS p FROM streams),
lines AS (SELECT run_id, stream, exit_code, i::INT AS origin, CASE WHEN i < len(p) THEN regexp_replace(p[i], '\r\z', '') ELSE p[i] END AS text
  FROM (SELECT *, unnest(range(1, len(p) + 1)) AS i FROM parts) WHERE i < len(p) OR p[i] <> '')"""


def blocks() -> str:
    """From lines to split blocks (the marks of progress and line runs included)."""
    return f"""{lines()},
flag AS (SELECT run_id, stream, exit_code, origin, {blank("text")} AS blank, {like("text", chr(92) + "A[ " + chr(92) + "t]")} AS ind,
    {like("text", rf"\A[0-9]*{SPACE}*([\x7C=^]|\.\.\.)")} AS gut, {clean_line("text")} AS text FROM lines),
seg AS (SELECT *, sum(blank::INT) OVER (PARTITION BY run_id, stream ORDER BY origin) AS seg FROM flag),
fst AS (SELECT *, row_number() OVER (PARTITION BY run_id, stream, seg ORDER BY origin) = 1 AS fst FROM seg WHERE NOT blank),
cnt AS (SELECT *, NOT ind AND NOT gut AS margin, coalesce(sum((ind AND NOT fst)::INT) OVER w, 0) AS c FROM fst
    WINDOW w AS (PARTITION BY run_id, stream, seg ORDER BY origin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
bnd AS (SELECT *, fst OR (margin AND c > coalesce(last_value(CASE WHEN margin THEN c END IGNORE NULLS) OVER w, 0)) AS bnd FROM cnt
    WINDOW w AS (PARTITION BY run_id, stream, seg ORDER BY origin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
blk AS (SELECT run_id, stream, exit_code, origin, text, sum(bnd::INT) OVER (PARTITION BY run_id, stream ORDER BY origin) AS block, {progress("text")} AS prog FROM bnd),
pro AS (SELECT *, min(prog::INT) OVER (PARTITION BY run_id, stream, block) = 1 AS all_prog,
    coalesce(text <> lag(text) OVER (PARTITION BY run_id, stream, block ORDER BY origin), true)::INT AS nw FROM blk),
rns AS (SELECT *, sum(nw) OVER (PARTITION BY run_id, stream, block ORDER BY origin) AS rn FROM pro),
siz AS (SELECT *, count(*) OVER (PARTITION BY run_id, stream, block, rn) AS n,
    row_number() OVER (PARTITION BY run_id, stream, block, rn ORDER BY origin) AS k FROM rns),
pre AS (SELECT *, lag(n) OVER w AS was, row_number() OVER w = 1 AS first FROM siz WINDOW w AS (PARTITION BY run_id, stream, block ORDER BY origin)),
cut AS (SELECT *, first OR (NOT all_prog AND ((n >= 3 AND k IN (1, 2)) OR (k = 1 AND coalesce(was, 0) >= 3))) AS cut FROM pre),
spl AS (SELECT run_id, stream, exit_code, origin, text, all_prog, NOT all_prog AND n >= 3 AND k = 1 AS ann, NOT all_prog AND n >= 3 AND k > 1 AS cp, n,
    sum(cut::INT) OVER (PARTITION BY run_id, stream ORDER BY origin) AS block FROM cut),
b0 AS (SELECT run_id, stream, block, any_value(exit_code) AS exit_code, count(*)::INT AS n_lines, min(origin) AS first_origin, bool_or(all_prog) AS prog, bool_or(cp) AS cp, bool_or(ann) AS ann,
    string_agg(text || CASE WHEN ann THEN '  [{T.TAG}: ×' || n || ']' ELSE '' END, chr(10) ORDER BY origin) AS txt,
    arg_min(CASE WHEN {failing("text")} THEN CASE WHEN {testing("text")} THEN 2 ELSE 1 END END, origin) AS fail,
    bool_or({warning("text")}) AS warn, bool_or({content("text")}) AS content
  FROM spl GROUP BY run_id, stream, block),
b1 AS (SELECT *, CASE WHEN prog THEN 'progress' WHEN cp THEN 'dedupe' END AS reason FROM b0)"""


def adjacent() -> str:
    return f"""{blocks()},
a1 AS (SELECT *, coalesce(reason IS NULL AND lag(reason) OVER w IS NULL AND txt = lag(txt) OVER w AND row_number() OVER w > 1, false) AS same FROM b1
    WINDOW w AS (PARTITION BY run_id, stream ORDER BY block)),
a2 AS (SELECT *, sum((NOT same)::INT) OVER (PARTITION BY run_id, stream ORDER BY block) AS isl FROM a1),
a3 AS (SELECT *, count(*) OVER (PARTITION BY run_id, stream, isl) AS m FROM a2),
b2 AS (SELECT * REPLACE (CASE WHEN same THEN 'dedupe' ELSE reason END AS reason, ann OR (NOT same AND m > 1) AS ann,
    CASE WHEN NOT same AND m > 1 AND NOT ann THEN txt || '  [{T.TAG}: ×' || m || ']' ELSE txt END AS txt) FROM a3)"""


def windows() -> str:
    """The greedy fold as a recursive query: one step tries one window at one place."""
    same = "list_position(list_transform(range(1, n + 1), lambda k: keys[s + k * w + 1:s + (k + 1) * w] = keys[s + 1:s + w]), false)"
    return f"""{adjacent()},
live AS (SELECT run_id, stream, list(block ORDER BY block) AS bs, list({sub("txt", "[0-9]+", "#")} ORDER BY block) AS keys, count(*) AS n
    FROM b2 WHERE reason IS NULL GROUP BY run_id, stream HAVING count(*) >= 6),
fold(run_id, stream, bs, keys, n, w, s, hit, r) AS (
  SELECT run_id, stream, bs, keys, n, least(8, n // 3), 0::BIGINT, NULL::BIGINT, NULL::BIGINT FROM live
  UNION ALL
  SELECT run_id, stream, bs, keys, n, CASE WHEN s + 3 * w > n THEN w - 1 ELSE w END,
    CASE WHEN s + 3 * w > n THEN 0 WHEN c >= 3 THEN s + w * c ELSE s + 1 END, CASE WHEN s + 3 * w <= n AND c >= 3 THEN s END, CASE WHEN s + 3 * w <= n AND c >= 3 THEN c END
  FROM (SELECT run_id, stream, bs, keys, n, w, s, CASE WHEN s + 3 * w <= n AND keys[s + 1:s + w] = keys[s + w + 1:s + 2 * w] THEN {same} ELSE 1 END AS c FROM fold WHERE w >= 2)),
hits AS (SELECT run_id, stream, bs, (s - w * r) AS h, w, r FROM fold WHERE hit IS NOT NULL),
gone AS (SELECT DISTINCT run_id, stream, unnest(bs[h + w + 1:h + w * r]) AS block FROM hits),
mark AS (SELECT run_id, stream, bs[h + w] AS block, arg_max(r, w) AS times FROM hits GROUP BY ALL),
b3 AS (SELECT b2.* REPLACE (CASE WHEN gone.block IS NOT NULL THEN 'dedupe' ELSE reason END AS reason, ann OR times IS NOT NULL AS ann,
    CASE WHEN times IS NOT NULL AND NOT ann THEN txt || '  [{T.TAG}: ×' || times || ']' ELSE txt END AS txt)
  FROM b2 LEFT JOIN gone USING (run_id, stream, block) LEFT JOIN mark USING (run_id, stream, block))"""


def classes(base: str = "b3") -> str:
    return f"""b4 AS (SELECT *, CASE WHEN prog THEN 'Progress' WHEN fail = 2 THEN 'Failure' WHEN fail = 1 THEN 'Error' WHEN warn THEN 'Warning'
    WHEN content OR ann THEN 'Info' ELSE 'Noise' END AS class, CASE WHEN reason IS NULL THEN 'Normal' ELSE 'Drop' END AS keep0 FROM {base})"""


def floor() -> str:
    return f"""f1 AS (SELECT *, max((class IN ('Error', 'Failure'))::INT) OVER (PARTITION BY run_id, stream) AS anyf,
    row_number() OVER (PARTITION BY run_id, stream ORDER BY block DESC) AS back FROM b4),
b5 AS (SELECT * EXCLUDE (anyf, back), CASE WHEN exit_code <> 0 AND anyf = 0 AND class <> 'Progress'
    AND back <= CASE WHEN stream = 'stderr' THEN {S.FLOOR["stderr"]} ELSE {S.FLOOR["stdout"]} END THEN 'Force' ELSE keep0 END AS keep1 FROM f1)"""


def context(k: int = S.CONTEXT) -> str:
    return f"""c1 AS (SELECT *, max((class IN ('Error', 'Failure'))::INT) OVER (PARTITION BY run_id, stream ORDER BY block ROWS BETWEEN {k} PRECEDING AND {k} FOLLOWING) AS near FROM b5),
b6 AS (SELECT * EXCLUDE (near, reason), CASE WHEN near = 1 AND class <> 'Progress' THEN 'Force' ELSE keep1 END AS keep,
    CASE WHEN (near = 1 AND class <> 'Progress') OR keep1 = 'Force' THEN NULL ELSE reason END AS reason FROM c1)"""


def full() -> str:
    return f"{windows()},\n{classes()},\n{floor()},\n{context()}"


def marker(n: str, reason: str, b: str) -> str:
    return f"'[{T.TAG}: ' || CASE WHEN {b} > 1 THEN {n} || ' lines in ' || {b} || ' blocks outside this view' WHEN {n} = 1 THEN '1 line outside this view' ELSE {n} || ' lines outside this view' END || ' · {reason}]'"


def summary() -> str:
    return f"""vw AS (SELECT run_id, stream, ln || ' lines · ' || fl || ' failing · ' || wn || ' warning' || CASE WHEN wn = 1 THEN '' ELSE 's' END || chr(10) || {marker("ln", R.REASONS["summary"], "1")} || chr(10) AS body
  FROM (SELECT run_id, stream, sum(n_lines) AS ln, count(*) FILTER (class IN ('Error', 'Failure')) AS fl, count(*) FILTER (class = 'Warning') AS wn FROM b6 GROUP BY run_id, stream))"""


def body(failures_only: bool = False) -> str:
    show = "keep <> 'Drop'" + (" AND class IN ('Error', 'Failure')" if failures_only else "")
    return f"""r1 AS (SELECT *, {show} AS shown FROM b6),
r2 AS (SELECT *, (shown OR coalesce(lag(shown) OVER (PARTITION BY run_id, stream ORDER BY block), true))::INT AS nw FROM r1),
r3 AS (SELECT *, sum(nw) OVER (PARTITION BY run_id, stream ORDER BY block) AS part FROM r2),
r4 AS (SELECT run_id, stream, part, CASE WHEN bool_or(shown) THEN min(txt) ELSE {marker("sum(n_lines)", R.REASONS["filtered"], "count(*)")} END AS piece FROM r3 GROUP BY run_id, stream, part),
vw AS (SELECT run_id, stream, string_agg(piece, chr(10) ORDER BY part) || chr(10) AS body FROM r4 GROUP BY run_id, stream)"""


def view(level: int, streams: str = EVENTS) -> str:
    made = summary() if level == R.SUMMARY else body(level == R.ITEMS)
    return f"WITH RECURSIVE {streams},\n{full()},\n{made}\nSELECT run_id, stream, {level}::INT AS level, coalesce(body, '') AS body FROM streams LEFT JOIN vw USING (run_id, stream)"

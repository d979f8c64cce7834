"""SQL for the registered queries, for DuckDB over the same tables. A query has none where SQL can't express it."""

from __future__ import annotations

EVENTS = "(SELECT event_id + 1 AS seq, sha256(user_id::VARCHAR || '|' || event_type) AS fp, (user_id % 4096 + 4096)::INT AS size FROM events)"
FILES = "(SELECT l_suppkey AS file_id, ((l_orderkey * 8 + l_linenumber) * 10000000 + l_partkey) * 100 + l_quantity::BIGINT AS seq, sha256(l_partkey::VARCHAR) AS fp, (l_quantity * 100)::INT AS size FROM lineitem)"
CHUNKS = "(SELECT doc_id, source, lang, sha256(text) AS fp, strlen(text) AS size FROM documents WHERE text IS NOT NULL)"
DOCS = "(SELECT doc_id AS file_id, coalesce(text, '') AS data, source, lang FROM documents)"


def byte_sum(fp: str) -> str:
    return f"list_sum(list_transform(range(32), lambda i: ('0x' || substr({fp}, 2 * i::INT + 1, 2))::INT))::INT"


def word(fp: str, i: int) -> str:
    return "('0x' || " + " || ".join(f"substr({fp}, {8 * i + k}, 2)" for k in (7, 5, 3, 1)) + ")::BIGINT"


def cells(src: str, width: int) -> str:
    rows = " UNION ALL ".join(f"SELECT seq, fp, {r} AS row, ({word('fp', r)} % {width})::INT AS pos FROM {src}" for r in range(4))
    return f"({rows})"


def divergence(freqs: str, by: str = "") -> str:
    h = "(log2(sum(freq)) - sum(freq * log2(freq)) / sum(freq))"
    return f"SELECT {by + ',' if by else ''} sum(freq)::BIGINT AS logical, count(*) AS distinct, round({h}, 9) AS entropy, round(log2(count(*)) - {h}, 9) AS kld FROM {freqs} {'GROUP BY ' + by if by else ''}"


def unit(expr: str) -> str:
    return f"(('0x' || substr(sha256({expr}), 1, 8))::BIGINT::DOUBLE / 4294967296.0)"


def running(width: int) -> str:
    return f"(SELECT seq, any_value(fp) AS fp, min(c) AS est FROM (SELECT seq, fp, count(*) OVER (PARTITION BY row, pos ORDER BY seq) AS c FROM {cells(EVENTS, width)}) GROUP BY seq)"


def totals(src: str, by: str = "") -> str:
    k = f"{by}, " if by else ""
    return f"SELECT {k} sum(n)::BIGINT AS logical_chunks, sum(s)::BIGINT AS logical_size, count(*) AS unique_chunks, sum(one)::BIGINT AS unique_size, round(sum(s) / sum(one), 9) AS dedup_ratio FROM (SELECT {k} fp, count(*) AS n, sum(size) AS s, min(size) AS one FROM {src} GROUP BY {k} fp) {'GROUP BY ' + by if by else ''}"


def solver(freqs: str, blowup: float) -> str:
    """The definition as it reads, over every frequency in ascending order."""
    return f"""WITH s AS (SELECT freq AS f, row_number() OVER (ORDER BY freq) - 1 AS i, count(*) OVER () AS n, sum(freq) OVER () AS t, sum(freq) OVER (ORDER BY freq ROWS UNBOUNDED PRECEDING) - freq AS p FROM {freqs}),
    e AS (SELECT *, ceil(n * {blowup} - 1e-9) AS e FROM s)
    SELECT (CASE WHEN (SELECT min(f) FROM e) >= (SELECT any_value(t / e) FROM e) THEN 1 ELSE coalesce((SELECT ceil(greatest(1.0, (t - p) / (e - i))) FROM e WHERE i >= 1 AND e > i AND f * (e - i) >= t - p ORDER BY i LIMIT 1), 1) END)::BIGINT AS t"""


SEGMENTED = f"""WITH RECURSIVE o AS MATERIALIZED (SELECT file_id, seq, fp, size, {byte_sum('fp')} AS value, row_number() OVER (PARTITION BY file_id ORDER BY seq) AS rn FROM {FILES}),
walk AS (
  SELECT file_id, rn, 0::BIGINT AS segment, 1 AS cnt, size::BIGINT AS total FROM o WHERE rn = 1
  UNION ALL
  SELECT o.file_id, o.rn, CASE WHEN w.cnt + 1 > 40 OR w.total + o.size > 80000 OR (w.total + o.size >= 20000 AND o.value % 8 = 1) THEN w.segment + 1 ELSE w.segment END,
    CASE WHEN w.cnt + 1 > 40 OR w.total + o.size > 80000 OR (w.total + o.size >= 20000 AND o.value % 8 = 1) THEN 1 ELSE w.cnt + 1 END,
    CASE WHEN w.cnt + 1 > 40 OR w.total + o.size > 80000 OR (w.total + o.size >= 20000 AND o.value % 8 = 1) THEN o.size::BIGINT ELSE w.total + o.size END
  FROM walk w JOIN o ON o.file_id = w.file_id AND o.rn = w.rn + 1),
seg AS (SELECT o.*, w.segment FROM o JOIN walk w USING (file_id, rn)),
summ AS (SELECT file_id, segment, count(*) AS chunk_num, sum(size)::BIGINT AS seg_size, min(seq) AS first_seq, arg_min(fp, {{'v': value, 's': seq}}) AS min_fp, sha256(string_agg(size::VARCHAR || ':' || fp, ',' ORDER BY seq)) AS seg_hash FROM seg GROUP BY file_id, segment),
ranked AS (SELECT *, row_number() OVER (PARTITION BY min_fp ORDER BY file_id, segment) AS rk, first_value(seg_hash) OVER (PARTITION BY min_fp ORDER BY file_id, segment) AS first_hash FROM summ),
kept AS (SELECT s.min_fp, g.fp, arg_min(g.size, {{'f': g.file_id, 's': g.seq}}) AS size FROM seg g JOIN summ s USING (file_id, segment) GROUP BY s.min_fp, g.fp)
"""


def replayed(k: int, batch: int, width: int) -> str:
    """The frequency set's replay, a row after the other: `top` is the set in the order in which its members leave it."""
    held = "list_contains(list_transform(w.top, lambda x: x.fp), r.fp)"
    new = "{'freq': r.est, 'came': r.i, 'fp': r.fp}"
    again = "{'freq': r.est, 'came': list_filter(w.top, lambda x: x.fp = r.fp)[1].came, 'fp': r.fp}"
    return f"""(WITH RECURSIVE e AS (SELECT (seq - 1) // {batch} AS batch, fp, min(seq) AS seq, count(*) AS n, arg_max(est, seq) AS est FROM {running(width)} GROUP BY ALL),
    r AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY batch, seq) AS i FROM e),
    walk AS (
      SELECT 0::BIGINT AS i, -1::BIGINT AS batch, []::STRUCT(freq BIGINT, came BIGINT, fp VARCHAR)[] AS top, []::VARCHAR[] AS known, 0::BIGINT AS bar
      UNION ALL
      SELECT r.i, r.batch,
        CASE WHEN {held} THEN CASE WHEN len(w.top) < {k} OR r.est >= w.top[1].freq THEN list_sort(list_append(list_filter(w.top, lambda x: x.fp <> r.fp), {again})) ELSE w.top END
          WHEN len(w.top) < {k} THEN list_sort(list_append(w.top, {new}))
          WHEN r.est >= w.top[1].freq THEN list_sort(list_append(w.top[2:], {new})) ELSE w.top END,
        CASE WHEN r.batch <> w.batch THEN list_transform(w.top, lambda x: x.fp) ELSE w.known END,
        CASE WHEN r.batch = w.batch THEN w.bar WHEN len(w.top) >= {k} THEN w.top[1].freq ELSE 0 END
      FROM walk w JOIN r ON r.i = w.i + 1)
    SELECT r.batch, r.fp, r.n, r.est, CASE WHEN r.est >= w.bar AND list_contains(w.known, r.fp) THEN 'inside' ELSE 'outer' END AS served FROM r JOIN walk w USING (i))"""


def located(champions: int, per_hook: int, bits: int) -> str:
    """The locality index, a segment after the other: manifests as lists of fingerprints, hooks with the manifests that they name."""
    return SEGMENTED + f""", numbered AS MATERIALIZED (SELECT file_id, segment, fp, dense_rank() OVER (ORDER BY fp) AS f, ('0x' || substr(fp, 1, 2))::INT < {1 << (8 - bits)} AS hook FROM seg),
s AS MATERIALIZED (SELECT file_id, segment, count(*) AS chunks, list(DISTINCT f) AS fps, coalesce(list(DISTINCT f) FILTER (WHERE hook), []) AS hooks, row_number() OVER (ORDER BY file_id, segment) AS i FROM numbered GROUP BY file_id, segment),
found AS (
  SELECT 0::BIGINT AS i, 0::BIGINT AS stored, []::BIGINT[][] AS manifests, []::STRUCT(h BIGINT, m BIGINT)[] AS hooks
  UNION ALL
  SELECT i, len(fresh), CASE WHEN len(fresh) > 0 THEN list_append(manifests, fps) ELSE manifests END,
    CASE WHEN len(fresh) > 0 THEN list_concat(hooks, list_transform(own, lambda h: {{'h': h, 'm': len(manifests) + 1}})) ELSE hooks END
  FROM (SELECT *, list_filter(fps, lambda f: NOT list_contains(known, f)) AS fresh
  FROM (SELECT *, flatten(list_transform(list_sort(list_transform(list_distinct(newest), lambda m: {{'hits': -len(list_filter(newest, lambda y: y = m)), 'm': m}}))[:{champions}], lambda c: manifests[c.m])) AS known
  FROM (SELECT *, list_transform(list_filter(met, lambda x: len(list_filter(met, lambda y: y.h = x.h AND y.m > x.m)) < {per_hook}), lambda x: x.m) AS newest
  FROM (SELECT s.i, s.fps, s.hooks AS own, w.manifests, w.hooks, list_filter(w.hooks, lambda x: list_contains(s.hooks, x.h)) AS met FROM found w JOIN s ON s.i = w.i + 1)))))
SELECT file_id, sum(chunks)::BIGINT AS chunks, sum(stored)::BIGINT AS stored, count_if(stored > 0)::BIGINT AS manifests FROM s JOIN found USING (i) GROUP BY file_id"""


OUTER = f"(SELECT fp, count(*) AS freq FROM {replayed(64, 128, 512)} WHERE served = 'outer' GROUP BY fp)"
HOOKS = f"(SELECT DISTINCT (seq - 1) // 64 AS segment, fp AS hook FROM {EVENTS} WHERE ('0x' || substr(fp, 1, 2))::INT < 16)"
HOOK_INDEX = f"(SELECT hook, segment AS manifest FROM (SELECT *, row_number() OVER (PARTITION BY hook ORDER BY segment DESC) AS r FROM {HOOKS}) WHERE r <= 5)"
CANDIDATES = f"(SELECT h.segment, i.manifest, count(*) AS hits FROM {HOOKS} h JOIN {HOOK_INDEX} i USING (hook) GROUP BY ALL)"
DOC_TRACE = f"(SELECT doc_id AS seq, fp, size FROM {CHUNKS})"
LABELLED = f"(SELECT * FROM {DOC_TRACE} WHERE seq IN (SELECT doc_id FROM labels))"
STATES = f"(SELECT seq, fp, est, least(floor({unit(chr(39) + 'tunable|' + chr(39) + ' || seq::VARCHAR || ' + chr(39) + '|' + chr(39) + ' || fp')} * (est // 5 + 1)), est // 5)::BIGINT AS state FROM {running(512)})"
RUN = f"(SELECT (seq - 1) // 128 AS batch, fp, seq, est FROM {running(512)})"
FIRSTS = f"(SELECT fp, min(seq) AS seq, arg_min(size, seq) AS size FROM {EVENTS} GROUP BY fp)"
PACKED = """WITH RECURSIVE o AS MATERIALIZED (SELECT source AS writer, doc_id AS seq, strlen(text) AS length, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM documents WHERE text IS NOT NULL),
walk AS (SELECT writer, rn, 0 AS number, 0::BIGINT AS offs, (16 + length)::BIGINT AS used FROM o WHERE rn = 1
  UNION ALL SELECT o.writer, o.rn, CASE WHEN 16 + o.length + w.used >= 65536 THEN w.number + 1 ELSE w.number END, CASE WHEN 16 + o.length + w.used >= 65536 THEN 0 ELSE w.used END, CASE WHEN 16 + o.length + w.used >= 65536 THEN 16 + o.length ELSE w.used + 16 + o.length END
  FROM walk w JOIN o ON o.writer IS NOT DISTINCT FROM w.writer AND o.rn = w.rn + 1)
SELECT o.writer, o.seq, o.length, w.offs AS "offset", o.writer || '-' || lpad(w.number::VARCHAR, 8, '0') AS container FROM o JOIN walk w ON o.writer IS NOT DISTINCT FROM w.writer AND o.rn = w.rn"""


def fixed(size: int, digest: str) -> str:
    return f"SELECT file_id, i AS seq, i * {size} AS \"offset\", length(substr(data, (i * {size} + 1)::INT, {size}))::INT AS size, {digest}(substr(data, (i * {size} + 1)::INT, {size})) AS fp FROM (SELECT file_id, data, unnest(range((length(data) + {size - 1}) // {size})) AS i FROM {DOCS})"


ZIPF = f"""WITH r AS (SELECT range AS rank, pow(range::DOUBLE, -0.9) AS w FROM range(1, 201)), c AS (SELECT rank, sum(w) OVER (ORDER BY rank) AS upto, w, sum(w) OVER () AS all_w FROM r),
b AS (SELECT rank, (upto - w) / all_w AS lo, upto / all_w AS hi FROM c), d AS (SELECT range AS seq, {unit("'zipf|' || range::VARCHAR")} AS u FROM range(201, 1001)),
e AS (SELECT seq, min(rank) AS rank FROM d JOIN b ON u >= lo AND u < hi GROUP BY seq UNION ALL SELECT range, range FROM range(1, 201))
SELECT seq, sha256('zipf|' || rank::VARCHAR) AS fp, 8192 AS size FROM e"""



def pieces(size: int) -> str:
    """The documents (without empty ones) in pieces of so many bytes, as hex."""
    return f"(SELECT file_id, i AS seq, substr(h, (i * {2 * size} + 1)::INT, {2 * size}) AS piece FROM (SELECT file_id, h, unnest(range((length(h) + {2 * size - 1}) // {2 * size})) AS i FROM (SELECT file_id, hex(encode(data)) AS h FROM {DOCS} WHERE data <> '')))"


STORED = f"(SELECT piece, length(piece) // 2 AS n FROM {pieces(1024)} UNION ALL SELECT substr(h, (i * 2048 + 1)::INT, 2048), length(substr(h, (i * 2048 + 1)::INT, 2048)) // 2 FROM (SELECT h, unnest(range((length(h) + 2047) // 2048)) AS i FROM (SELECT hex(encode(text)) AS h FROM benchmark WHERE text <> '')))"
SKETCH_T = solver(f"(SELECT count(*) AS freq FROM {cells(EVENTS, 512)} WHERE row = 0 GROUP BY pos)", 1.15)
SPREAD = f"(SELECT fp, least(floor({unit(chr(39) + 'tunable|' + chr(39) + ' || seq::VARCHAR || ' + chr(39) + '|' + chr(39) + ' || fp')} * (est // t + 1)), est // t)::BIGINT AS state FROM {running(512)}, ({SKETCH_T}))"



def _steps(source: str, steps: list[tuple[str, str]]) -> str:
    """source with columns replaced one after the other."""
    for name, expr in steps:
        source = f"SELECT * REPLACE ({expr} AS {name}) FROM ({source})"
    return source


def _turned(x: str, r: int, bits: int = 32) -> str:
    return f"((({x} << {r}) | ({x} >> {bits - r})) & {_ones(bits)})"


def _ones(bits: int) -> str:
    return f"{2**bits - 1}::{'UBIGINT' if bits == 32 else 'UHUGEINT'}"


def _mixed(h: str, bits: int = 32) -> list[tuple[str, str]]:
    """The published algorithm's last mixing of a word."""
    (a, b, c), f = ((16, 13, 16), (0x85EBCA6B, 0xC2B2AE35)) if bits == 32 else ((33, 33, 33), (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53))
    kind = "UBIGINT" if bits == 32 else "UHUGEINT"
    return [(h, f"(xor({h}, {h} >> {a}) * {f[0]}::{kind}) & {_ones(bits)}"), (h, f"(xor({h}, {h} >> {b}) * {f[1]}::{kind}) & {_ones(bits)}"), (h, f"xor({h}, {h} >> {c})")]


def murmur32(src: str, seed: int) -> str:
    """fp, h: MurmurHash3 (x86, 32 bits) of a 32-byte digest, by the published algorithm on plain integers."""
    one, steps = _ones(32), []
    for i in range(8):
        steps += [("k", f"({word('fp', i)}::UBIGINT * 3432918353::UBIGINT) & {one}"), ("k", f"({_turned('k', 15)} * 461845907::UBIGINT) & {one}"), ("h", "xor(h, k)"), ("h", f"({_turned('h', 13)} * 5 + 3864292196) & {one}")]
    return _steps(f"SELECT DISTINCT fp, {seed}::UBIGINT AS h, 0::UBIGINT AS k FROM {src}", [*steps, ("h", "xor(h, 32::UBIGINT)"), *_mixed("h")])


def murmur128(src: str, seed: int) -> str:
    """fp, h1, h2: MurmurHash3 (x64, 128 bits) of a 32-byte digest."""
    c, one, steps = ("9782798678568883157::UHUGEINT", "5545529020109919103::UHUGEINT"), _ones(64), []
    lanes = (("h1", "h2", 31, 27, 1390208809), ("h2", "h1", 33, 31, 944331445))
    for at in range(4):
        h, other, r, s, add = lanes[at % 2]
        steps += [("k", f"(({word('fp', 2 * at)}::UHUGEINT | ({word('fp', 2 * at + 1)}::UHUGEINT << 32)) * {c[at % 2]}) & {one}"), ("k", f"({_turned('k', r, 64)} * {c[1 - at % 2]}) & {one}"), (h, f"xor({h}, k)")]
        steps += [(h, f"({_turned(h, s, 64)} + {other}) & {one}"), (h, f"({h} * 5 + {add}) & {one}")]
    summed = [("h1", f"(h1 + h2) & {one}"), ("h2", f"(h2 + h1) & {one}")]
    ends = [*((h, f"xor({h}, 32::UHUGEINT)") for h in ("h1", "h2")), *summed, *_mixed("h1", 64), *_mixed("h2", 64), *summed]
    return _steps(f"SELECT DISTINCT fp, {seed}::UHUGEINT AS h1, {seed}::UHUGEINT AS h2, 0::UHUGEINT AS k FROM {src}", steps + ends)


def murmur128_x86(src: str, seed: int) -> str:
    """fp, h0 to h3: MurmurHash3 (x86, 128 bits) of a 32-byte digest."""
    c, add, turns = (597399067, 2869860233, 951274213, 2716044179), (1444728091, 197830471, 2530024501, 850148119), ((15, 19), (16, 17), (17, 15), (18, 13))
    one, steps = _ones(32), []
    for at in range(8):
        i, after = at % 4, (at + 1) % 4
        steps += [("k", f"({word('fp', at)}::UBIGINT * {c[i]}::UBIGINT) & {one}"), ("k", f"({_turned('k', turns[i][0])} * {c[after]}::UBIGINT) & {one}"), (f"h{i}", f"xor(h{i}, k)")]
        steps += [(f"h{i}", f"({_turned(f'h{i}', turns[i][1])} + h{after}) & {one}"), (f"h{i}", f"(h{i} * 5 + {add[i]}) & {one}")]
    summed = [("h0", f"(h0 + h1 + h2 + h3) & {one}"), *((f"h{i}", f"(h{i} + h0) & {one}") for i in (1, 2, 3))]
    ends = [*((f"h{i}", f"xor(h{i}, 32::UBIGINT)") for i in range(4)), *summed, *(s for i in range(4) for s in _mixed(f"h{i}")), *summed]
    return _steps(f"SELECT DISTINCT fp, {', '.join(f'{seed}::UBIGINT AS h{i}' for i in range(4))}, 0::UBIGINT AS k FROM {src}", steps + ends)


def murmur_cells(width: int) -> str:
    return " UNION ALL ".join(f"SELECT {r} AS row, (h % {width})::INT AS pos, n FROM ({murmur32(EVENTS, r)}) JOIN n USING (fp)" for r in range(4))


def _hex(x: str, digits: int) -> str:
    return f"lpad(lower(to_hex({x}::UBIGINT)), {digits}, '0')"


COUNTED = f"n AS (SELECT fp, count(*) AS n FROM {EVENTS} GROUP BY fp)"

ORACLES: dict[str, str] = {
    "murmur_hashes": f"SELECT fp, h::BIGINT AS h32, {_hex('h1', 16)} || {_hex('h2', 16)} AS h128, h128_x86 FROM ({murmur32(EVENTS, 1)}) JOIN (SELECT fp, h1, h2 FROM ({murmur128(EVENTS, 1)})) USING (fp) JOIN (SELECT fp, {' || '.join(_hex(f'h{i}', 8) for i in range(4))} AS h128_x86 FROM ({murmur128_x86(EVENTS, 1)})) USING (fp)",
    "cms_murmur_cells": f"WITH {COUNTED} SELECT row, pos, sum(n)::BIGINT AS cnt FROM ({murmur_cells(4096)}) GROUP BY row, pos",
    "cms_murmur128_cells": f"WITH {COUNTED}, m AS MATERIALIZED ({murmur128(EVENTS, 0)}), w AS (SELECT fp, unnest([{{'row': 0, 'w': h1 & {_ones(64)} & 4294967295}}, {{'row': 1, 'w': h1 >> 32}}, {{'row': 2, 'w': h2 & 4294967295}}, {{'row': 3, 'w': h2 >> 32}}], recursive := true) FROM m) SELECT row, (w % 4096)::INT AS pos, sum(n)::BIGINT AS cnt FROM w JOIN n USING (fp) GROUP BY row, pos",
    "ingest_statistics": f"SELECT (SELECT count(*) FROM {STORED}) AS logical_chunks, (SELECT sum(n) FROM {STORED})::BIGINT AS logical_size, count(*) AS unique_chunks, sum(n)::BIGINT AS unique_size FROM (SELECT DISTINCT piece, n FROM {STORED})",
    "ingest_by_strategy": f"SELECT s AS strategy, count(DISTINCT piece) AS different_chunks, count(*) AS logical_chunks, CASE WHEN s IN ('exact', 'frequency') THEN count(DISTINCT piece) END AS stored_chunks, count(DISTINCT file_id) AS files, count(DISTINCT file_id) AS equal_files FROM {pieces(512)}, (VALUES ('exact'), ('frequency'), ('similarity'), ('locality')) v(s) GROUP BY s",
    "scheme_round_trip": f"WITH p AS MATERIALIZED {pieces(512)} SELECT file_id, sha256(data) AS digest, s AS scheme, CASE WHEN s = 'tunable' THEN (SELECT count(*) FROM (SELECT DISTINCT piece, file_id % 2 FROM p)) ELSE (SELECT count(DISTINCT piece) FROM p) END AS stored FROM {DOCS}, (VALUES ('plain'), ('convergent'), ('server_aided'), ('tunable')) v(s) WHERE data <> ''",
    "tunable_leakage": f"SELECT p.kld AS plain_kld, p.distinct AS plain_distinct, c.kld AS cipher_kld, c.distinct AS cipher_distinct, t FROM ({divergence('(SELECT fp, count(*) AS freq FROM ' + EVENTS + ' GROUP BY fp)')}) p, ({divergence('(SELECT fp, state, count(*) AS freq FROM ' + SPREAD + ' GROUP BY fp, state)')}) c, ({SKETCH_T})",
    "random_draws_others": f"WITH p AS (SELECT range AS k, sum(exp(-3.0 + range * ln(3.0) - lgamma(range + 1))) OVER (ORDER BY range) AS c FROM range(200)) SELECT event_id, round(sqrt(-2 * ln(1 - {unit("'u|' || event_id::VARCHAR")})) * cos(2 * pi() * {unit("'v|' || event_id::VARCHAR")}) * 0.25 + 2.0, 9) AS normal, (SELECT count(*) FROM p WHERE c < 1 - 1e-12 AND c <= {unit('event_id::VARCHAR')}) AS poisson FROM events",
    "file_scan": "SELECT 5::BIGINT AS n_files, true AS whole",
    "trace_parse": f"SELECT seq, substr(fp, 1, 12) AS fp, least(size * 3, 16384)::INT AS size FROM {EVENTS}",
    "trace_parse_short": f"SELECT seq, substr(fp, 1, 10) AS fp, least(size, 16384)::INT AS size FROM {EVENTS}",
    "trace_concat": f"SELECT row_number() OVER (ORDER BY t, seq) AS seq, fp, size FROM (SELECT 0 AS t, * FROM {EVENTS} UNION ALL SELECT 1, seq, fp, size::INT FROM {DOC_TRACE})",
    "dense_numbers": "SELECT l_orderkey, l_linenumber, row_number() OVER (ORDER BY l_orderkey, l_linenumber) AS seq FROM lineitem",
    "recipe_heads": f"SELECT file_id, sum(size)::BIGINT AS file_size, count(*) AS chunk_num FROM {FILES} GROUP BY file_id",
    "store_round_trip": f"SELECT 'd' || file_id AS file_id, sha256(data) AS digest, strlen(data) AS size FROM {DOCS} WHERE data <> '' UNION ALL SELECT 'b' || item_id, sha256(text), strlen(text) FROM benchmark WHERE text <> ''",
    "statistics_carry_over": f"WITH t AS ({totals(CHUNKS)} UNION ALL {totals('(SELECT sha256(html) AS fp, strlen(html) AS size FROM pages WHERE html IS NOT NULL)')}) SELECT sum(logical_chunks)::BIGINT AS logical_chunks, sum(logical_size)::BIGINT AS logical_size, sum(unique_chunks)::BIGINT AS unique_chunks, sum(unique_size)::BIGINT AS unique_size FROM t",
    "kv_latest": "SELECT key, arg_max(value, since) AS value FROM (SELECT c_custkey AS key, c_mktsegment AS value, -1 AS since FROM customer UNION ALL SELECT user_id, event_type, event_id FROM events) GROUP BY key",
    "kv_lookup": "SELECT c_custkey AS key, value FROM customer LEFT JOIN (SELECT user_id, arg_max(event_type, event_id) AS value FROM events GROUP BY user_id) ON user_id = c_custkey",
    "fixed_size_chunks": fixed(512, "sha256"),
    "fixed_size_chunks_blocks": f"""SELECT file_id, row_number() OVER (PARTITION BY file_id ORDER BY o) - 1 AS seq, o AS "offset", length(piece)::INT AS size, md5(piece) AS fp FROM (
        SELECT file_id, b * 1000 + i * 300 AS o, substr(data, (b * 1000 + i * 300 + 1)::INT, least(300, 1000 - i * 300)::INT) AS piece FROM (SELECT file_id, data, b, unnest(range(4)) AS i FROM (SELECT file_id, data, unnest(range((length(data) + 999) // 1000)) AS b FROM {DOCS})) WHERE b * 1000 + i * 300 < length(data))""",
    "content_chunk_totals": f"SELECT file_id, strlen(data) AS total, true AS in_bounds FROM {DOCS} WHERE data <> ''",
    "content_chunk_restore": f"SELECT file_id, sha256(data) AS digest FROM {DOCS} WHERE data <> ''",
    "fingerprints": f"SELECT file_id, sha256(data) AS sha256, sha1(data) AS sha1, md5(data) AS md5 FROM {DOCS}",
    "hash_value_sum": f"SELECT doc_id, {byte_sum('fp')} AS value FROM {CHUNKS}",
    "hook_sample": f"SELECT seq, fp FROM {EVENTS} WHERE ('0x' || substr(fp, 1, 2))::INT < 4",
    "size_clamp": f"SELECT doc_id, least(size, 1000) AS size FROM {CHUNKS}",
    "file_ids": f"SELECT file_id, sha256(concat_ws('/', lang, file_id::VARCHAR)) AS name_id FROM {DOCS}",
    "compression_round_trip": f"SELECT file_id, true AS no_larger, sha256(data) AS digest FROM {DOCS}",
    "encryption_round_trip": f"SELECT file_id, strlen(data) + 28 AS size, sha256(data) AS a, sha256(data) AS b FROM {DOCS}",
    "first_seen_chunks": f"SELECT fp, seq, size FROM {FIRSTS}",
    "first_flags": f"SELECT seq, row_number() OVER (PARTITION BY fp ORDER BY seq) = 1 AS is_first FROM {EVENTS}",
    "anti_join_new_chunks": f"SELECT fp, min(seq) AS seq, arg_min(size, seq)::INT AS size FROM {DOC_TRACE} WHERE fp NOT IN (SELECT fp FROM {LABELLED}) GROUP BY fp",
    "semi_join_known_chunks": f"SELECT seq, fp FROM {DOC_TRACE} WHERE fp IN (SELECT fp FROM {LABELLED})",
    "outer_index_probe": f"SELECT seq, sha256('s|index|' || fp) AS fp, fp IN (SELECT fp FROM {LABELLED}) AS is_known FROM {DOC_TRACE}",
    "index_union": f"SELECT fp, min(seq) AS seq, arg_min(size, seq)::INT AS size FROM {LABELLED} GROUP BY fp UNION ALL SELECT fp, min(seq), arg_min(size, seq)::INT FROM {DOC_TRACE} WHERE fp NOT IN (SELECT fp FROM {LABELLED}) GROUP BY fp",
    "batch_dup_flags": f"SELECT seq, batch, CASE WHEN r = 1 THEN '' ELSE 'TMP_' END || CASE WHEN since < batch THEN 'DUPLICATE' ELSE 'UNIQUE' END AS flag FROM (SELECT seq, (seq - 1) // 128 AS batch, row_number() OVER (PARTITION BY fp, (seq - 1) // 128 ORDER BY seq) AS r, min((seq - 1) // 128) OVER (PARTITION BY fp) AS since FROM {EVENTS})",
    "batch_key_sets": f"SELECT DISTINCT (seq - 1) // 128 AS batch, fp FROM {EVENTS}",
    "streaming_exact_dedup": f"SELECT DISTINCT fp, size FROM {EVENTS}",
    "chunk_frequency": f"SELECT fp, count(*) AS freq FROM {EVENTS} GROUP BY fp",
    "frequencies_ascending": f"SELECT count(*) AS freq FROM {EVENTS} GROUP BY fp",
    "freq_of_freq": f"SELECT freq, count(*) AS n_fps FROM (SELECT count(*) AS freq FROM {EVENTS} GROUP BY fp) GROUP BY freq",
    "kld_plain": divergence(f"(SELECT fp, count(*) AS freq FROM {CHUNKS} GROUP BY fp)"),
    "kld_by_source": divergence(f"(SELECT source, fp, count(*) AS freq FROM {CHUNKS} GROUP BY source, fp)", "source"),
    "kld_trace": divergence(f"(SELECT fp, count(*) AS freq FROM {FILES} GROUP BY fp)"),
    "cms_cells": f"SELECT row, pos, count(*) AS cnt FROM {cells(EVENTS, 4096)} GROUP BY row, pos",
    "cms_merged": f"SELECT row, pos, count(*) AS cnt FROM (SELECT row, pos FROM {cells(EVENTS, 4096)} UNION ALL SELECT row, pos FROM {cells(FILES, 4096)}) GROUP BY row, pos",
    "cms_estimate": f"WITH c AS {cells(EVENTS, 512)}, s AS (SELECT row, pos, count(*) AS cnt FROM c GROUP BY row, pos) SELECT fp, min(cnt) AS est FROM (SELECT DISTINCT fp, row, pos FROM c) JOIN s USING (row, pos) GROUP BY fp",
    "cms_first_row": f"SELECT pos, count(*) AS cnt FROM {cells(EVENTS, 4096)} WHERE row = 0 GROUP BY pos",
    "cms_total": "SELECT count(*) AS total FROM events",
    "cms_running_estimate": f"SELECT seq, fp, est FROM {running(512)}",
    "batch_latest_freq": f"SELECT batch, fp, arg_max(est, seq) AS est FROM {RUN} GROUP BY batch, fp",
    "topk_chunks": f"SELECT fp, cnt, row_number() OVER (ORDER BY cnt DESC, fp) AS rank FROM (SELECT fp, count(*) AS cnt FROM {EVENTS} GROUP BY fp) ORDER BY cnt DESC, fp LIMIT 100",
    "topk_by_estimate": f"WITH c AS {cells(EVENTS, 512)}, s AS (SELECT row, pos, count(*) AS cnt FROM c GROUP BY row, pos) SELECT fp, min(cnt) AS est FROM (SELECT DISTINCT fp, row, pos FROM c) JOIN s USING (row, pos) GROUP BY fp ORDER BY est DESC, fp LIMIT 50",
    "solver_threshold": solver(f"(SELECT count(*) AS freq FROM {FILES} GROUP BY fp)", 1.15),
    "solver_threshold_sketch": solver(f"(SELECT count(*) AS freq FROM {cells(EVENTS, 512)} WHERE row = 0 GROUP BY pos)", 1.3),
    "tunable_state_counts": f"SELECT fp, state, count(*) AS freq FROM {STATES} GROUP BY fp, state",
    "tunable_kld": divergence(f"(SELECT fp, state, count(*) AS freq FROM {STATES} GROUP BY fp, state)"),
    "frequency_replay": f"SELECT * FROM {replayed(64, 128, 512)}",
    "frequency_replay_per_chunk": f"SELECT * FROM {replayed(64, 1, 512)}",
    "frequency_totals": f"WITH x AS MATERIALIZED {replayed(64, 128, 512)}, f AS (SELECT fp, min(batch) AS since FROM x GROUP BY fp) SELECT sum(n)::BIGINT AS logical_chunks, count(DISTINCT fp) AS unique_chunks, count_if(served = 'inside')::BIGINT AS inside_probes, count_if(served = 'outer')::BIGINT AS outer_probes, count_if(served = 'outer' AND batch > since)::BIGINT AS outer_duplicates, sum(n - 1)::BIGINT AS batch_duplicates FROM x JOIN f USING (fp)",
    "frequency_leakage": f"SELECT p.logical, p.distinct, p.kld AS plain_kld, o.logical AS observed, o.kld AS cipher_kld FROM ({divergence('(SELECT fp, count(*) AS freq FROM ' + EVENTS + ' GROUP BY fp)')}) p, ({divergence(OUTER)}) o",
    "frequency_leakage_large_set": f"SELECT p.logical, p.distinct, p.kld AS plain_kld, p.distinct AS observed, 0.0::DOUBLE AS cipher_kld FROM ({divergence('(SELECT fp, count(*) AS freq FROM ' + EVENTS + ' GROUP BY fp)')}) p",
    "segment_min_fp": f"SELECT (seq - 1) // 64 AS segment, count(*) AS chunk_num, sum(size)::BIGINT AS seg_size, arg_min(fp, {{'v': {byte_sum('fp')}, 's': seq}}) AS min_fp, sha256(string_agg(size::VARCHAR || ':' || fp, ',' ORDER BY seq)) AS seg_hash FROM {EVENTS} GROUP BY 1",
    "content_segment_summaries": SEGMENTED + "SELECT file_id, segment, chunk_num, seg_size, first_seq, min_fp, seg_hash FROM summ",
    "similarity_segments": SEGMENTED + "SELECT CASE WHEN rk = 1 THEN 'unique' WHEN seg_hash = first_hash THEN 'duplicate' ELSE 'different' END AS kind, count(*) AS n_segments, sum(chunk_num)::BIGINT AS n_chunks FROM ranked GROUP BY 1",
    "similarity_dedup_stats": SEGMENTED + "SELECT count(*) AS stored_chunks, sum(size)::BIGINT AS stored_size, count(DISTINCT fp) AS unique_chunks FROM kept",
    "strategy_totals": SEGMENTED + f"SELECT 'similarity' AS strategy, count(*) AS stored, count(DISTINCT fp) AS \"unique\" FROM kept UNION ALL SELECT s, count(DISTINCT fp), count(DISTINCT fp) FROM {FILES}, (VALUES ('exact'), ('frequency')) v(s) GROUP BY s",
    "locality_dedup": located(10, 10, 4),
    "hook_fifo_cap": f"SELECT hook, manifest FROM {HOOK_INDEX}",
    "hook_manifest_candidates": f"SELECT * FROM {CANDIDATES}",
    "champion_top10": f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY segment ORDER BY hits DESC, manifest) AS rank FROM {CANDIDATES}) WHERE rank <= 10",
    "container_packing": PACKED,
    "recipe_restore_lengths": f"SELECT f.file_id, count(*) AS chunk_num, sum(s.size)::BIGINT AS length FROM {FILES} f JOIN (SELECT fp, arg_min(size, seq) AS size FROM {FILES} GROUP BY fp) s USING (fp) GROUP BY f.file_id",
    "chunk_recipes": f"SELECT f.file_id, f.seq, substr(fp, 1, 4) AS container, s.seq AS \"offset\", s.size AS length FROM {FILES} f JOIN (SELECT fp, min(seq) AS seq, arg_min(size, seq) AS size FROM {FILES} GROUP BY fp) s USING (fp)",
    "dedup_stats": totals(CHUNKS),
    "dedup_ratio_by_source": totals(CHUNKS, "source"),
    "cumulative_snapshot_stats": f"""WITH l AS (SELECT source, count(*) AS n, sum(size) AS s FROM {CHUNKS} GROUP BY source), u AS (SELECT source, count(*) AS n, sum(size) AS s FROM (SELECT fp, min(source) AS source, min(size) AS size FROM {CHUNKS} GROUP BY fp) GROUP BY source)
        SELECT l.source, sum(l.n) OVER w::BIGINT AS logical_chunks, sum(l.s) OVER w::BIGINT AS logical_size, sum(coalesce(u.n, 0)) OVER w::BIGINT AS unique_chunks, sum(coalesce(u.s, 0)) OVER w::BIGINT AS unique_size FROM l LEFT JOIN u USING (source) WINDOW w AS (ORDER BY l.source NULLS FIRST)""",
    "compression_ratios": "SELECT round(sum(n * size) / sum(size), 9) AS dedup_ratio, true AS compression_helps FROM (SELECT count(*) AS n, any_value(strlen(text)) AS size FROM documents WHERE text <> '' GROUP BY text)",
    "key_metadata_overhead": f"SELECT source, unique_chunks * 16 + 64 AS shared_keys, logical_chunks * 32 AS own_keys FROM ({totals(CHUNKS, 'source')})",
    "content_keys": f"SELECT doc_id, repeat('01', 32) AS plain, fp AS convergent, sha256('chunkloom' || fp) AS server_aided, sha256(fp || sha256(fp || '|3|chunkloom')) AS tunable FROM {CHUNKS}",
    "scheme_comparison": f"SELECT s AS scheme, CASE WHEN s = 'tunable' THEN (SELECT count(*) FROM (SELECT DISTINCT fp, state FROM {STATES})) ELSE count(DISTINCT fp) END AS unique_chunks, CASE WHEN s = 'plain' THEN 0 ELSE count(*) * 32 END AS key_bytes FROM {EVENTS}, (VALUES ('plain'), ('convergent'), ('server_aided'), ('tunable')) v(s) GROUP BY s",
    "cipher_fingerprints": f"SELECT count(DISTINCT data) AS ciphers, count(DISTINCT data) AS contents FROM {DOCS}",
    "key_recipe_restore": f"SELECT file_id, sha256(data) AS digest FROM {DOCS}",
    "cipher_index": f"SELECT min(file_id) AS seq FROM {DOCS} GROUP BY data",
    "zipf_trace": ZIPF,
    "random_draws": f"SELECT event_id, round({unit('event_id::VARCHAR')} * 3.0 + 2.0, 9) AS uniform, floor(ln(1 - {unit('event_id::VARCHAR')}) / ln(0.8))::BIGINT AS geometric FROM events",
    "synthetic_content": f"SELECT fp, min(size)::INT AS size, fp AS head FROM {EVENTS} GROUP BY fp",
}

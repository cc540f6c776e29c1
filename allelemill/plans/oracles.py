"""SQL for what the alignments tell: the closed forms over tables of common lengths, by recursive common table expressions.

Two kinds of tables. For pairs of short names a row of the table is one number, whose zero bits mark where the length grows.
For alleles, which change few symbols of long references, a row is a band of columns around the diagonal of a window; windows
are narrow first, and wide for the few alleles whose spanning edit reaches the border of a narrow one.
"""

from __future__ import annotations

from .derived import SQL, distance_sql

RECURSIVE = SQL.replace("WITH dna", "WITH RECURSIVE dna", 1)


def _hgvs(reference: str, start: str, end: str, seq: str) -> str:
    """Plain HGVS of an edit of `reference`."""
    return f"""CASE WHEN {start} = {end} AND {seq} = '' THEN '=' WHEN {start} = {end} THEN concat({start}, '_', {start} + 1, 'ins', {seq})
  WHEN {end} - {start} = 1 AND length({seq}) = 1 THEN concat({end}, substr({reference}, CAST({end} AS INT), 1), '>', {seq})
  ELSE concat(CASE WHEN {end} - {start} = 1 THEN CAST({end} AS VARCHAR) ELSE concat({start} + 1, '_', {end}) END, 'del', CASE WHEN {seq} = '' THEN '' ELSE concat('ins', {seq}) END) END"""


# ---- names: a and b of some ten symbols ----------------------------------------------------------------------------------


def _bits(name: str, a: str, b: str) -> str:
    """Rows (key, i, v) of the table of `a` against `b` (expressions over names)."""
    mask = "coalesce(list_sum(list_transform(range(1, length(y) + 1), lambda j: CASE WHEN substr(y, CAST(j AS INT), 1) = substr(x, CAST(i + 1 AS INT), 1) THEN CAST(1 AS BIGINT) << CAST(j - 1 AS INT) ELSE 0 END)), 0)"
    return f"""{name} AS (
  SELECT key, {a} AS x, {b} AS y, CAST(0 AS BIGINT) AS i, (CAST(1 AS BIGINT) << CAST(length(b) AS INT)) - 1 AS v FROM names
  UNION ALL
  SELECT key, x, y, i + 1, CAST(((v + (v & m)) | (v - (v & m))) & ((CAST(1 AS BIGINT) << CAST(length(y) AS INT)) - 1) AS BIGINT)
  FROM (SELECT *, CAST({mask} AS BIGINT) AS m FROM {name} WHERE i < length(x))
)"""


_LENGTH = "({j} - bit_count({v} & ((CAST(1 AS BIGINT) << CAST({j} AS INT)) - 1)))"
_AHEAD, _BEHIND = _LENGTH.format(j="c", v="f.v"), _LENGTH.format(j="(length(f.y) - c - 1)", v="g.v")

NAMES = RECURSIVE + ", " + _bits("ahead", "a", "b") + ", " + _bits("behind", "reverse(a)", "reverse(b)") + f""", sizes AS (
  SELECT key, x AS a, y AS b, CAST(length(x) AS BIGINT) AS n, CAST(length(y) AS BIGINT) AS m, length(y) - bit_count(v) AS l FROM ahead WHERE i = length(x)
), matches AS (
  SELECT key, r, c, rank FROM (
    SELECT f.key, f.i AS r, c, {_AHEAD} AS rank, {_BEHIND} AS after, substr(f.x, CAST(f.i + 1 AS INT), 1) = substr(f.y, CAST(c + 1 AS INT), 1) AS same
    FROM (SELECT *, unnest(range(0, length(y))) AS c FROM ahead WHERE i < length(x)) f JOIN behind g ON g.key = f.key AND g.i = length(f.x) - f.i - 1
  ) JOIN sizes USING (key) WHERE same AND rank + 1 + after = l
), cells AS (
  SELECT key, r, c, rank FROM matches UNION ALL SELECT key, -1, -1, -1 FROM names UNION ALL SELECT key, n, m, l FROM sizes
), steps AS (
  SELECT p.key, p.rank, p.r AS pr, p.c AS pc, q.r AS qr, q.c AS qc, p.r + 1 AS vstart, q.r AS vend, substr(b, CAST(p.c + 2 AS INT), CAST(q.c - p.c - 1 AS INT)) AS seq
  FROM cells p JOIN cells q ON q.key = p.key AND q.rank = p.rank + 1 AND q.r > p.r AND q.c > p.c JOIN sizes s ON s.key = p.key
), edits_of AS (SELECT * FROM steps WHERE vstart < vend OR seq <> '')
"""  # fmt: skip

EDGES = NAMES + "SELECT DISTINCT key, concat(vstart, ':', vend, '/', seq) AS edge FROM edits_of"
GRAPH_STEPS = NAMES + "SELECT key, pr AS row, pc AS col, concat(vstart, ':', vend, '/', seq) AS edge FROM edits_of"

GRAPH_NODES = NAMES + """SELECT key, min(r) AS row, min(c) AS col, CAST(count(*) AS INT) AS length
FROM (SELECT key, r, c, r - row_number() OVER (PARTITION BY key, r - c ORDER BY r) AS island FROM matches) GROUP BY key, r - c, island"""

PATH_COUNT = NAMES + """, ways AS (
  SELECT key, rank, r, c, CAST(1 AS HUGEINT) AS n FROM cells WHERE rank = -1
  UNION ALL
  SELECT s.key, s.rank + 1, s.qr, s.qc, CAST(sum(w.n) AS HUGEINT) FROM ways w JOIN steps s ON s.key = w.key AND s.rank = w.rank AND s.pr = w.r AND s.pc = w.c GROUP BY s.key, s.rank, s.qr, s.qc
) SELECT w.key, CAST(w.n AS BIGINT) AS paths FROM ways w JOIN sizes s ON s.key = w.key AND w.rank = s.l"""

PATHS = NAMES + f""", walks AS (
  SELECT key, rank, r, c, CAST([] AS BIGINT[]) AS places, CAST([] AS VARCHAR[]) AS texts FROM cells WHERE rank = -1
  UNION ALL
  SELECT s.key, s.rank + 1, s.qr, s.qc, list_concat(places, [s.qr, s.qc]), CASE WHEN s.vstart = s.vend AND s.seq = '' THEN texts ELSE list_append(texts, {_hgvs("z.a", "s.vstart", "s.vend", "s.seq")}) END
  FROM walks w JOIN steps s ON s.key = w.key AND s.rank = w.rank AND s.pr = w.r AND s.pc = w.c JOIN sizes z ON z.key = s.key
) SELECT w.key, CAST(row_number() OVER (PARTITION BY w.key ORDER BY places) - 1 AS BIGINT) AS path,
  CASE len(texts) WHEN 0 THEN '=' WHEN 1 THEN texts[1] ELSE concat('[', array_to_string(texts, ';'), ']') END AS hgvs
FROM walks w JOIN sizes s ON s.key = w.key AND w.rank = s.l"""  # fmt: skip

DIAGONAL = NAMES + """, greedy AS (
  SELECT key, rank, r, c FROM cells WHERE rank = -1
  UNION ALL
  SELECT key, rank + 1, best.r, best.c FROM (
    SELECT g.key, g.rank, arg_min({'r': q.r, 'c': q.c}, [CASE WHEN q.r - q.c = s.n - s.m THEN 0 ELSE 1 END, abs(q.r - q.c), q.r, q.c]) AS best
    FROM greedy g JOIN cells q ON q.key = g.key AND q.rank = g.rank + 1 AND q.r > g.r AND q.c > g.c JOIN sizes s ON s.key = g.key GROUP BY g.key, g.rank)
), taken AS (
  SELECT g.key, lag(g.r) OVER w + 1 AS vstart, g.r AS vend, substr(b, CAST(lag(g.c) OVER w + 2 AS INT), CAST(g.c - lag(g.c) OVER w - 1 AS INT)) AS seq
  FROM greedy g JOIN sizes s ON s.key = g.key WINDOW w AS (PARTITION BY g.key ORDER BY g.rank)
) SELECT key, concat(vstart, ':', vend, '/', seq) AS variant FROM taken WHERE vstart IS NOT NULL AND (vstart < vend OR seq <> '')"""

DOT_LINES = NAMES + f""", core AS (
  SELECT key, min(vstart) AS low, max(vend) AS high FROM edits_of GROUP BY key
), graph AS (
  SELECT s.*, row_number() OVER (PARTITION BY s.key ORDER BY rank, pr, pc, qr, qc) AS no FROM steps s JOIN core o ON o.key = s.key AND pr >= low - 1 AND qr <= high
), met AS (
  SELECT key, pr AS r, pc AS c, 2 * no AS turn FROM graph UNION ALL SELECT key, qr, qc, 2 * no + 1 FROM graph
), nodes AS (
  SELECT key, r, c, row_number() OVER (PARTITION BY key ORDER BY min(turn)) - 1 AS no, (key, r, c) NOT IN (SELECT (key, pr, pc) FROM graph) AS last FROM met GROUP BY key, r, c
), head AS (
  SELECT s.key, s.a, coalesce(o.low, 0) AS low, coalesce(o.high, 0) AS high, s.m - s.n AS more, s.b FROM sizes s LEFT JOIN core o ON o.key = s.key
), lines AS (
  SELECT key, 0 AS part, unnest(range(0, 8)) AS no, unnest(['digraph{{', concat('comment="reference:', substr(a, CAST(low + 1 AS INT), CAST(high - low AS INT)), '"'),
    concat('comment="observed:', CASE WHEN high > low OR more <> 0 THEN substr(b, CAST(low + 1 AS INT), CAST(high + more - low AS INT)) ELSE '' END, '"'), 'rankdir=LR', 'edge[fontname=monospace]',
    'node[fixedsize=true,fontname=serif,shape=circle,width=.8]', 'si[label="",shape=none,width=0]', 'si->s0']) AS line FROM head
  UNION ALL SELECT key, 1, no, concat('s', no, '[label="s', no, '"', CASE WHEN last THEN ',peripheries=2' ELSE '' END, ']') FROM nodes
  UNION ALL SELECT key, 1, 0, 's0[label="s0",peripheries=2]' FROM head WHERE key NOT IN (SELECT key FROM core)
  UNION ALL SELECT g.key, 2, g.no, concat('s', p.no, '->s', q.no, '[label="', {_hgvs("z.a", "g.vstart", "g.vend", "g.seq")}, '"]')
    FROM graph g JOIN nodes p ON p.key = g.key AND p.r = g.pr AND p.c = g.pc JOIN nodes q ON q.key = g.key AND q.r = g.qr AND q.c = g.qc JOIN sizes z ON z.key = g.key
  UNION ALL SELECT key, 3, 0, '}}' FROM head
) SELECT key, CAST(row_number() OVER (PARTITION BY key ORDER BY part, no) - 1 AS INT) AS line_no, line FROM lines"""  # fmt: skip

# What the graph tells of a pair, for the relations of names.
_UNITS = """SELECT key, vstart + k AS pos, '' AS symbol FROM (SELECT key, vstart, unnest(range(0, vend - vstart)) AS k FROM {edges})
  UNION SELECT key, vstart + k, substr(seq, CAST(j + 1 AS INT), 1) FROM (SELECT key, vstart, seq, k, unnest(range(0, length(seq))) AS j FROM (SELECT key, vstart, seq, unnest(range(0, vend - vstart + 1)) AS k FROM {edges}))"""


def _sides() -> str:
    """`shared`: keys of names whose two alleles (a to b, a to c) have a unit edit in common. Every unit edit of an edge is one of
    some minimal alignment, in any order of deletions and insertions."""
    second = NAMES[len(RECURSIVE) :].replace("names", "other").replace("ahead", "ahead2").replace("behind", "behind2").replace("sizes", "sizes2").replace("matches", "matches2").replace("cells", "cells2").replace("steps", "steps2").replace("edits_of", "edits_of2")
    return NAMES + ", other AS (SELECT key, a, c AS b FROM names)" + second + f""", shared AS (
  SELECT DISTINCT l.key FROM ({_UNITS.format(edges="edits_of")}) l JOIN ({_UNITS.format(edges="edits_of2")}) r ON r.key = l.key AND r.pos = l.pos AND r.symbol = l.symbol
)"""


def relation_of_names(wanted: str, distances: str) -> str:
    by_distance = "b <> c AND dl + dr <> d AND dl - dr <> d AND dr - dl <> d"
    where = f"{by_distance} AND key IN (SELECT key FROM shared)" if wanted == "overlap" else f"b <> c AND (dl + dr = d OR ({by_distance} AND key NOT IN (SELECT key FROM shared)))"
    return _sides() + f" SELECT key FROM (SELECT key, b, c, {distances} FROM names) WHERE {where}"


ATOMICS = SQL.replace("WITH dna", "WITH RECURSIVE dna", 1) + """, ways AS (
  SELECT ref_id, vstart, vend, seq, CAST(0 AS BIGINT) AS gone, CAST(0 AS BIGINT) AS put, '' AS turns, CAST([] AS VARCHAR[]) AS texts FROM edits
  UNION ALL
  SELECT ref_id, vstart, vend, seq, gone + (1 - ins), put + ins, concat(turns, CASE ins WHEN 1 THEN '0' ELSE '1' END),
    CASE WHEN ins = 0 THEN list_append(texts, concat(vstart + gone, ':', vstart + gone + 1, '/'))
         WHEN ends_with(turns, '0') THEN list_append(texts[1:len(texts) - 1], concat(texts[len(texts)], substr(seq, CAST(put + 1 AS INT), 1)))
         ELSE list_append(texts, concat(vstart + gone, ':', vstart + gone, '/', substr(seq, CAST(put + 1 AS INT), 1))) END
  FROM ways, (VALUES (CAST(0 AS BIGINT)), (CAST(1 AS BIGINT))) t(ins) WHERE CASE ins WHEN 1 THEN put < length(seq) ELSE gone < vend - vstart END
)
SELECT ref_id, vstart, vend, seq, CAST(row_number() OVER (PARTITION BY ref_id, vstart, vend, seq ORDER BY turns) - 1 AS BIGINT) AS way, array_to_string(texts, ';') AS edits
FROM ways WHERE gone = vend - vstart AND put = length(seq)"""

# ---- alleles: bands ------------------------------------------------------------------------------------------------------

#: Edits of the derived table delete and insert three symbols at most; so do bands of one allele, and of two twice that.
ONE, TWO = 7, 13
NARROW, WIDE = 12, 3000
_OUT = -1000


def _band(name: str, source: str, x: str, y: str, off: str, width: int) -> str:
    """Rows (id, i, f0, f1, ...) of the table of x against y: column k of row i is column i + off + k of the table.
    source: id, and what the expressions x, y and off use. Lengths are columns of their own, as DuckDB remembers what one column's
    dictionary tells, which a recursion makes anew each time."""
    column = lambda k: f"(i + 1 + o + {k})"
    first = ", ".join(f"CASE WHEN o + {k} BETWEEN 0 AND ny THEN 0 ELSE {_OUT} END AS f{k}" for k in range(width))
    grown = []
    for k in range(width):
        match = f"w.f{k} + CASE WHEN i + o + {k} >= 0 AND substr(x, CAST(i + 1 AS INT), 1) = substr(y, CAST(i + o + {k} + 1 AS INT), 1) THEN 1 ELSE 0 END"
        options = [match] + ([f"w.f{k + 1}"] if k + 1 < width else []) + ([f"n{k - 1}"] if k else [])
        grown.append(f"CASE WHEN {column(k)} BETWEEN 0 AND ny THEN greatest({', '.join(options)}) ELSE {_OUT} END AS n{k}")
    return f"""{name}_texts AS MATERIALIZED (SELECT id, {x} AS x, {y} AS y, CAST({off} AS BIGINT) AS o, CAST(length({x}) AS BIGINT) AS nx, CAST(length({y}) AS BIGINT) AS ny FROM {source}), {name} AS (
  SELECT id, CAST(0 AS BIGINT) AS i, {first} FROM {name}_texts
  UNION ALL
  SELECT id, i + 1, {", ".join(f"n{k}" for k in range(width))} FROM (SELECT w.id, i, {", ".join(grown)} FROM {name} w JOIN {name}_texts t ON t.id = w.id WHERE i < nx)
)"""


def _list(prefix: str, width: int, back: bool = False) -> str:
    return "[" + ", ".join(f"{prefix}.f{k}" for k in (range(width - 1, -1, -1) if back else range(width))) + "]"


def _told(tag: str, pad: int, source: str) -> str:
    """For the alleles of `source` (id, ref_id, vstart, vend, seq, sequence): win, units, span, matches of windows of `pad`."""
    half = ONE // 2
    return f"""win{tag} AS MATERIALIZED (
  SELECT id, ref_id, low, length(sequence) AS whole, substr(sequence, CAST(low + 1 AS INT), CAST(high - low AS INT)) AS a,
    concat(substr(sequence, CAST(low + 1 AS INT), CAST(vstart - low AS INT)), seq, substr(sequence, CAST(vend + 1 AS INT), CAST(high - vend AS INT))) AS b, high - low AS n, high - low - (vend - vstart) + length(seq) AS m
  FROM (SELECT *, greatest(0, vstart - {pad}) AS low, least(length(sequence), vend + {pad}) AS high FROM {source})
), {_band(f"fore{tag}", f"win{tag}", "a", "b", f"-{half}", ONE)}, {_band(f"back{tag}", f"win{tag}", "reverse(a)", "reverse(b)", f"m - n - {half}", ONE)}, filled{tag} AS MATERIALIZED (
  SELECT w.id, w.ref_id, low, whole, a, b, n, m, {_list("f", ONE)}[m - n + {half} + 1] AS l FROM win{tag} w JOIN fore{tag} f ON f.id = w.id AND f.i = w.n
), pairs{tag} AS (
  SELECT w.id, w.low, w.a, w.b, w.n, w.m, w.l, f.i, {_list("f", ONE)} AS f, {_list("h", ONE, True)} AS here, {_list("g", ONE, True)} AS next, k
  FROM filled{tag} w JOIN fore{tag} f ON f.id = w.id JOIN back{tag} h ON h.id = w.id AND h.i = w.n - f.i LEFT JOIN back{tag} g ON g.id = w.id AND g.i = w.n - f.i - 1 CROSS JOIN (SELECT range AS k FROM range(0, {ONE})) t
), units{tag} AS MATERIALIZED (
  SELECT DISTINCT id, i + low AS pos, '' AS symbol FROM pairs{tag} WHERE i < n AND k > 0 AND f[k + 1] + next[k] = l
  UNION SELECT id, i + low, substr(b, CAST(i - {half} + k + 1 AS INT), 1) FROM pairs{tag} WHERE k < {ONE - 1} AND i - {half} + k BETWEEN 0 AND m - 1 AND f[k + 1] + here[k + 2] = l
), span{tag} AS MATERIALIZED (
  SELECT *, substr(b, CAST(vstart - low + 1 AS INT), CAST(vend - vstart + m - n AS INT)) AS seq, n + m - 2 * l AS distance,
    (vstart = low AND low > 0) OR (vend = low + n AND low + n < whole) AS narrow
  FROM (SELECT w.*, u.vstart, u.vend FROM filled{tag} w JOIN (SELECT id, min(pos) AS vstart, max(pos + CASE WHEN symbol = '' THEN 1 ELSE 0 END) AS vend FROM units{tag} GROUP BY id) u ON u.id = w.id)
)"""


def _cells(tag: str) -> str:
    """Matches between the ends of the spanning edit, and the two cells around it; then `kept`, those of fewest edits."""
    half = ONE // 2
    grow = lambda name, one, more: f"""{name} AS (
  SELECT id, rank, r, c, 0 AS cost FROM cells{tag} WHERE {one}
  UNION ALL
  SELECT q.id, q.rank, q.r, q.c, min(p.cost + CASE WHEN abs(q.r - p.r) = 1 AND abs(q.c - p.c) = 1 THEN 0 ELSE 1 END)
  FROM {name} p JOIN cells{tag} q ON q.id = p.id AND q.rank = p.rank {more[0]} 1 AND q.r {more[1]} p.r AND q.c {more[1]} p.c GROUP BY q.id, q.rank, q.r, q.c
)"""  # noqa: E731
    return f"""cells{tag} AS MATERIALIZED (
  SELECT id, rank, r, c, false AS first, false AS last FROM (
    SELECT p.id, p.i AS r, p.i - {half} + k AS c, f[k + 1] AS rank FROM pairs{tag} p JOIN span{tag} s ON s.id = p.id
    WHERE NOT s.narrow AND p.i >= s.vstart - s.low AND p.i < s.vend - s.low AND p.i - {half} + k BETWEEN 0 AND p.m - 1
      AND substr(p.a, CAST(p.i + 1 AS INT), 1) = substr(p.b, CAST(p.i - {half} + k + 1 AS INT), 1) AND f[k + 1] + 1 + next[k + 1] = p.l)
  UNION ALL SELECT id, vstart - low - 1, vstart - low - 1, vstart - low - 1, true, false FROM span{tag} WHERE NOT narrow
  UNION ALL SELECT id, l - (low + n - vend), vend - low, vend - low + m - n, false, true FROM span{tag} WHERE NOT narrow
), {grow(f"cheap{tag}", "first", "+>")}, {grow(f"dear{tag}", "last", "-<")}, kept{tag} AS MATERIALIZED (
  SELECT x.id, x.rank, x.r, x.c FROM cheap{tag} x JOIN dear{tag} y ON y.id = x.id AND y.r = x.r AND y.c = x.c
  QUALIFY x.cost + y.cost = min(x.cost + y.cost) OVER (PARTITION BY x.id)
)"""


def _gaps(cells: str, tag: str) -> str:
    """Edits between ranks of one cell."""
    return f"""SELECT o.id, s.low + lag(r) OVER w + 1 AS vstart, s.low + r AS vend, substr(s.b, CAST(lag(c) OVER w + 2 AS INT), CAST(c - lag(c) OVER w - 1 AS INT)) AS seq
  FROM (SELECT id, rank, min(r) AS r, min(c) AS c FROM {cells}{tag} GROUP BY id, rank HAVING count(*) = 1) o JOIN span{tag} s ON s.id = o.id WINDOW w AS (PARTITION BY o.id ORDER BY rank)"""


ALLELES = RECURSIVE + f""", known AS MATERIALIZED (
  SELECT concat_ws(':', ref_id, vstart, vend, seq) AS id, ref_id, vstart, vend, seq, sequence FROM edits JOIN dna USING (ref_id)
), {_told("", NARROW, "known")}, again AS MATERIALIZED (SELECT k.* FROM known k JOIN span s ON s.id = k.id WHERE s.narrow), {_told("2", WIDE, "again")}, units_all AS MATERIALIZED (
  SELECT u.* FROM units u JOIN span s ON s.id = u.id WHERE NOT s.narrow UNION ALL SELECT * FROM units2
), told AS MATERIALIZED (
  SELECT id, ref_id, vstart, vend, seq, distance FROM span WHERE NOT narrow UNION ALL SELECT id, ref_id, vstart, vend, seq, distance FROM span2
  UNION ALL SELECT id, ref_id, 0, 0, '', 0 FROM known WHERE substr(sequence, CAST(vstart + 1 AS INT), CAST(vend - vstart AS INT)) = seq
)"""  # fmt: skip

SUPREMAL = ALLELES + " SELECT id AS allele_id, CAST(distance AS BIGINT) AS distance, concat(vstart, ':', vend, '/', seq) AS supremal FROM told"
UNIQ_ATOMICS = ALLELES + " SELECT id AS allele_id, pos, symbol FROM units_all"

FORMS = ALLELES + f", {_cells('')}, {_cells('2')}"
_EACH = "FROM ({}) WHERE vstart IS NOT NULL AND (vstart < vend OR seq <> '')"
_CANONICAL = f"{_gaps('kept', '')} UNION ALL {_gaps('kept', '2')}"
LOCAL_SUPREMAL = FORMS + " SELECT id AS allele_id, concat(vstart, ':', vend, '/', seq) AS variant " + _EACH.format(f"{_gaps('cells', '')} UNION ALL {_gaps('cells', '2')}")
CANONICAL = FORMS + " SELECT id AS allele_id, concat(vstart, ':', vend, '/', seq) AS variant " + _EACH.format(_CANONICAL)


def _period(w: str) -> str:
    """The length of the shortest unit of a word, 0 of none."""
    return f"coalesce(list_filter(range(1, length({w}) + 1), lambda p: substr({w}, CAST(p + 1 AS INT)) = left({w}, CAST(length({w}) - p AS INT)))[1], 0)"


def _place(start: str, end: str) -> str:
    return f"CASE WHEN {end} = {start} THEN concat({start}, '_', {start} + 1) WHEN {end} - {start} = 1 THEN CAST({end} AS VARCHAR) ELSE concat({start} + 1, '_', {end}) END"


#: Rich HGVS of each row of `variants` (id, vstart, vend, seq, old), as `texts` (id, vstart, text).
_TEXTS = f"""units_of AS (SELECT *, {_period("old")} AS po, {_period("seq")} AS pn FROM variants
), lead AS (SELECT *, CASE WHEN pn > po THEN left(seq, CAST(pn AS INT)) ELSE left(old, CAST(po AS INT)) END AS unit, CASE WHEN pn > po THEN length(seq) % pn WHEN po > 0 THEN length(old) % po ELSE 0 END AS over FROM units_of
), read AS (
  SELECT *, length(unit) AS u,
    CASE WHEN left(old, CAST(po AS INT)) = unit THEN length(old) // nullif(po, 0) WHEN po < length(unit) AND starts_with(old, unit) THEN 1 END AS co,
    CASE WHEN left(seq, CAST(pn AS INT)) = unit THEN length(seq) // nullif(pn, 0) WHEN pn < length(unit) AND starts_with(seq, unit) THEN 1 END AS cn,
    CASE WHEN left(old, CAST(po AS INT)) = unit THEN length(old) % po ELSE over END AS xo, CASE WHEN left(seq, CAST(pn AS INT)) = unit THEN length(seq) % pn ELSE over END AS xn
  FROM lead
), ends AS (
  SELECT *, (SELECT max(k) FROM range(0, 7000) t(k) WHERE k <= least(length(old), length(seq)) AND left(old, CAST(k AS INT)) = left(seq, CAST(k AS INT))) AS front FROM read
), core AS (
  SELECT *, substr(old, CAST(front + 1 AS INT), CAST(length(old) - front - rear AS INT)) AS gone, substr(seq, CAST(front + 1 AS INT), CAST(length(seq) - front - rear AS INT)) AS put, vstart + front AS s, vend - rear AS e
  FROM (SELECT *, (SELECT max(k) FROM range(0, 7000) t(k) WHERE k <= least(length(old), length(seq)) - front AND right(old, CAST(k AS INT)) = right(seq, CAST(k AS INT))) AS rear FROM ends)
), copies AS (SELECT *, {_period("put")} AS pp FROM core
), texts AS (
  SELECT id, vstart, CASE
    WHEN co IS NOT NULL AND cn IS NOT NULL AND co = 1 AND cn = 2 THEN concat({_place("(vstart + xn)", "(vstart + xn + u)")}, 'dup')
    WHEN co IS NOT NULL AND cn IS NOT NULL THEN concat({_place("(vstart + xo)", "vend")}, substr(seq, CAST(xn + 1 AS INT), CAST(u AS INT)), '[', cn, ']')
    WHEN length(put) > 1 AND put = reverse(translate(gone, 'ACGT', 'TGCA')) THEN concat({_place("s", "e")}, 'inv')
    WHEN pp > 0 AND length(put) // pp > 1 THEN concat({_place("s", "e")}, CASE WHEN gone = '' THEN 'ins' ELSE 'delins' END,
      CASE WHEN length(put) % pp > 0 THEN concat('[', left(put, CAST(pp AS INT)), '[', length(put) // pp, '];', left(put, CAST(length(put) % pp AS INT)), ']') ELSE concat(left(put, CAST(pp AS INT)), '[', length(put) // pp, ']') END)
    WHEN s = e THEN concat(s, '_', s + 1, 'ins', put)
    WHEN e - s = 1 AND length(put) = 1 THEN concat(e, gone, '>', put)
    ELSE concat({_place("s", "e")}, 'del', CASE WHEN put = '' THEN '' ELSE concat('ins', put) END) END AS text
  FROM copies
)"""

CANONICAL_HGVS = FORMS + f""", variants AS (
  SELECT v.id, v.vstart, v.vend, v.seq, substr(k.sequence, CAST(v.vstart + 1 AS INT), CAST(v.vend - v.vstart AS INT)) AS old {_EACH.format(_CANONICAL).replace("FROM (", "FROM (SELECT * FROM (", 1)}) v JOIN known k ON k.id = v.id
), {_TEXTS}
SELECT k.id AS allele_id, CASE coalesce(n, 0) WHEN 0 THEN '=' WHEN 1 THEN all_of ELSE concat('[', all_of, ']') END AS hgvs
FROM known k LEFT JOIN (SELECT id, count(*) AS n, string_agg(text, ';' ORDER BY vstart) AS all_of FROM texts GROUP BY id) t ON t.id = k.id"""  # fmt: skip

_HALF = TWO // 2
RELATIONS = ALLELES + f""", met AS MATERIALIZED (
  SELECT row_number() OVER () AS id, l.ref_id, l.id AS lhs_id, r.id AS rhs_id, l.vstart AS ls, l.vend AS le, l.seq AS lq, r.vstart AS rs, r.vend AS re, r.seq AS rq, l.distance AS dl, r.distance AS dr,
    least(l.vstart, r.vstart) AS low, greatest(l.vend, r.vend) AS high,
    CASE WHEN l.vstart = r.vstart AND l.vend = r.vend AND l.seq = r.seq THEN 'equivalent'
      WHEN (l.vstart = l.vend AND l.seq = '') OR (r.vstart = r.vend AND r.seq = '') THEN 'disjoint'
      WHEN NOT (r.vstart < l.vend AND l.vstart < r.vend) AND (r.vstart > l.vend OR l.vstart > r.vend OR NOT EXISTS (SELECT 1 FROM (VALUES ('A'), ('C'), ('G'), ('T')) t(x) WHERE contains(l.seq, x) AND contains(r.seq, x))) THEN 'disjoint' END AS native
  FROM told l JOIN told r ON l.ref_id = r.ref_id AND l.vstart <= r.vend AND r.vstart <= l.vend AND l.id < r.id
), seen AS MATERIALIZED (
  SELECT m.id, concat(substr(sequence, CAST(low + 1 AS INT), CAST(ls - low AS INT)), lq, substr(sequence, CAST(le + 1 AS INT), CAST(high - le AS INT))) AS x,
    concat(substr(sequence, CAST(low + 1 AS INT), CAST(rs - low AS INT)), rq, substr(sequence, CAST(re + 1 AS INT), CAST(high - re AS INT))) AS y
  FROM met m JOIN dna ON dna.ref_id = m.ref_id WHERE native IS NULL
), {_band("apart", "seen", "x", "y", f"-{_HALF}", TWO)}, gap AS MATERIALIZED (
  SELECT t.id, length(x) + length(y) - 2 * {_list("f", TWO)}[length(y) - length(x) + {_HALF} + 1] AS d FROM apart_texts t JOIN apart f ON f.id = t.id AND f.i = length(x)
), held AS MATERIALIZED (SELECT id, count(*) AS n FROM units_all GROUP BY id
), common AS MATERIALIZED (
  SELECT m.id, count(*) AS n FROM met m JOIN units_all u ON u.id = m.lhs_id JOIN units_all v ON v.id = m.rhs_id AND v.pos = u.pos AND v.symbol = u.symbol WHERE native IS NULL GROUP BY m.id
), related AS MATERIALIZED (
  SELECT m.ref_id, lhs_id, rhs_id, CASE WHEN native IS NOT NULL THEN native WHEN dl + dr = d THEN 'disjoint' WHEN dl - dr = d THEN 'contains' WHEN dr - dl = d THEN 'is_contained' WHEN c.n > 0 THEN 'overlap' ELSE 'disjoint' END AS relation, c.n AS common, p.n + q.n - c.n AS universe
  FROM met m LEFT JOIN gap g ON g.id = m.id LEFT JOIN common c ON c.id = m.id LEFT JOIN held p ON p.id = m.lhs_id LEFT JOIN held q ON q.id = m.rhs_id
)"""  # fmt: skip

RELATION_COMPARE = RELATIONS + " SELECT ref_id, lhs_id, rhs_id, relation, CASE WHEN relation = 'overlap' THEN CAST(common AS INT) END AS common, CASE WHEN relation = 'overlap' THEN CAST(universe AS INT) END AS universe FROM related"
RELATION_HISTOGRAM = RELATIONS + " SELECT relation, count(*) AS pairs FROM related GROUP BY relation"
OVERLAP_SIZES = RELATIONS + " SELECT lhs_id, rhs_id, CAST(common AS INT) AS common, CAST(universe AS INT) AS universe FROM related WHERE relation = 'overlap'"

_REAL = "(ls < le OR lq <> '') AND (rs < re OR rq <> '')"
_MIRROR = "CASE relation WHEN 'contains' THEN 'is_contained' WHEN 'is_contained' THEN 'contains' ELSE relation END"
CLASS_RELATIONS = RELATIONS + f""", classes AS (SELECT ref_id, vstart, vend, seq, min(id) AS class, count(*) AS members FROM told GROUP BY ALL
), of_class AS (SELECT t.id, class, members FROM told t JOIN classes c ON c.ref_id = t.ref_id AND c.vstart = t.vstart AND c.vend = t.vend AND c.seq = t.seq
), turned AS (
  SELECT r.ref_id, least(a.class, b.class) AS lhs_id, greatest(a.class, b.class) AS rhs_id, CASE WHEN a.class <= b.class THEN relation ELSE {_MIRROR} END AS relation,
    CASE WHEN relation = 'overlap' THEN CAST(common AS INT) END AS common, CASE WHEN relation = 'overlap' THEN CAST(universe AS INT) END AS universe,
    CASE WHEN a.class <= b.class THEN a.members ELSE b.members END AS lhs_members, CASE WHEN a.class <= b.class THEN b.members ELSE a.members END AS rhs_members
  FROM related r JOIN met m ON m.lhs_id = r.lhs_id AND m.rhs_id = r.rhs_id JOIN of_class a ON a.id = r.lhs_id JOIN of_class b ON b.id = r.rhs_id WHERE a.class = b.class OR ({_REAL})
) SELECT *, count(*) AS pairs FROM turned GROUP BY ALL"""

SUPREMAL_COMPARE = RELATIONS + f" SELECT r.ref_id, r.lhs_id, r.rhs_id, relation FROM related r JOIN met m ON m.lhs_id = r.lhs_id AND m.rhs_id = r.rhs_id WHERE {_REAL}"
SUPREMAL_CONTAINS = RELATIONS + """ SELECT ref_id, lhs_id, rhs_id FROM related WHERE relation = 'contains' UNION ALL SELECT ref_id, rhs_id, lhs_id FROM related WHERE relation = 'is_contained'"""


def _of_pairs(source: str, tag: str) -> str:
    """The tables of NAMES for another table of pairs (key, a, b)."""
    out = NAMES[len(RECURSIVE) :].replace("names", source)
    for name in ("ahead", "behind", "sizes", "matches", "cells", "steps", "edits_of"):
        out = out.replace(name, name + tag)
    return out


def _fewest(name: str, ends: str, turn: str) -> str:
    """Edits needed at least to reach each cell of `cells_p` from one end."""
    near, far = ("p", "q") if turn == "+" else ("q", "p")
    return f"""{name} AS (
  SELECT key, rank, r, c, 0 AS cost FROM cells_p WHERE {ends}
  UNION ALL
  SELECT s.key, s.rank {"+ 1" if turn == "+" else ""}, s.{far}r, s.{far}c, min(w.cost + CASE WHEN s.vstart = s.vend AND s.seq = '' THEN 0 ELSE 1 END)
  FROM {name} w JOIN steps_p s ON s.key = w.key AND s.rank {"" if turn == "+" else "+ 1"} = w.rank AND s.{near}r = w.r AND s.{near}c = w.c GROUP BY s.key, s.rank, s.{far}r, s.{far}c
)"""


def _relate(x: str, y: str) -> str:
    """How two parts (key, text, distance) relate; d{x}{y} is the distance between them."""
    shared = f"({x}k, {y}k) IN (SELECT (xk, yk) FROM shared_p)"
    return f"CASE WHEN {x}t = {y}t THEN 'equivalent' WHEN {x}d + {y}d = d{x}{y} THEN 'disjoint' WHEN {x}d - {y}d = d{x}{y} THEN 'contains' WHEN {y}d - {x}d = d{x}{y} THEN 'is_contained' WHEN {shared} THEN 'overlap' ELSE 'disjoint' END"


DIFFERENCE = RECURSIVE + f""", whole AS MATERIALIZED (SELECT row_number() OVER (ORDER BY a, b) AS key, a, b FROM (SELECT DISTINCT a, b FROM names)
), {_of_pairs("whole", "_w").lstrip(" ,")}, core_of AS MATERIALIZED (
  SELECT s.key, s.a, s.b, s.n, s.m, coalesce(low, 0) AS low, coalesce(high, 0) AS high FROM sizes_w s LEFT JOIN (SELECT key, min(vstart) AS low, max(vend) AS high FROM edits_of_w GROUP BY key) e ON e.key = s.key
), points AS MATERIALIZED (
  SELECT c.key, r, c FROM cells_w c JOIN core_of o ON o.key = c.key WHERE rank >= 0 AND r >= low AND r < high AND c.c >= low AND c.c < high + m - n AND rank < (SELECT l FROM sizes_w z WHERE z.key = c.key)
  UNION ALL SELECT key, low - 1, low - 1 FROM core_of UNION ALL SELECT key, high, high + m - n FROM core_of
), pairs AS MATERIALIZED (
  SELECT key, a, b, it, arg_min(ot, [pr, pc, qr, qc]) AS ot FROM (
    SELECT o.key, a, b, p.r AS pr, p.c AS pc, q.r AS qr, q.c AS qc,
      concat(left(a, CAST(p.r + 1 AS INT)), substr(b, CAST(p.c + 2 AS INT), CAST(q.c - p.c - 1 AS INT)), substr(a, CAST(q.r + 1 AS INT))) AS it,
      concat(left(b, CAST(p.c + 1 AS INT)), substr(a, CAST(p.r + 2 AS INT), CAST(q.r - p.r - 1 AS INT)), substr(b, CAST(q.c + 1 AS INT))) AS ot
    FROM points p JOIN points q ON q.key = p.key AND q.r > p.r AND q.c > p.c JOIN core_of o ON o.key = p.key)
  GROUP BY key, a, b, it
), parts AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY a, b) AS key, a, b FROM (SELECT a, it AS b FROM pairs UNION SELECT a, ot FROM pairs UNION SELECT a, b FROM pairs)
), {_of_pairs("parts", "_p").lstrip(" ,")}, units_p AS MATERIALIZED ({_UNITS.format(edges="edits_of_p")}
), {_fewest("cheap_p", "rank = -1", "+")}, {_fewest("dear_p", "rank = (SELECT l FROM sizes_p z WHERE z.key = cells_p.key)", "-")}, kept_p AS (
  SELECT x.key, x.rank, x.r, x.c FROM cheap_p x JOIN dear_p y ON y.key = x.key AND y.rank = x.rank AND y.r = x.r AND y.c = x.c QUALIFY x.cost + y.cost = min(x.cost + y.cost) OVER (PARTITION BY x.key)
), variants AS (
  SELECT id, vstart, vend, seq, substr(a, CAST(vstart + 1 AS INT), CAST(vend - vstart AS INT)) AS old FROM (
    SELECT o.key AS id, s.a, lag(r) OVER w + 1 AS vstart, r AS vend, substr(s.b, CAST(lag(c) OVER w + 2 AS INT), CAST(c - lag(c) OVER w - 1 AS INT)) AS seq
    FROM (SELECT key, rank, min(r) AS r, min(c) AS c FROM kept_p GROUP BY key, rank HAVING count(*) = 1) o JOIN sizes_p s ON s.key = o.key WINDOW w AS (PARTITION BY o.key ORDER BY rank)
  ) WHERE vstart IS NOT NULL AND (vstart < vend OR seq <> '')
), {_TEXTS.replace("range(0, 7000)", "range(0, 40)")}, told_p AS MATERIALIZED (
  SELECT s.key, s.a, s.b, s.n + s.m - 2 * s.l AS distance, CASE coalesce(t.n, 0) WHEN 0 THEN '=' WHEN 1 THEN all_of ELSE concat('[', all_of, ']') END AS hgvs
  FROM sizes_p s LEFT JOIN (SELECT id, count(*) AS n, string_agg(text, ';' ORDER BY vstart) AS all_of FROM texts GROUP BY id) t ON t.id = s.key
), joined AS MATERIALIZED (
  SELECT p.a, p.b, i.hgvs AS subtrahend_hgvs, o.hgvs AS remainder_hgvs, w.key AS wk, w.b AS wt, w.distance AS wd, i.key AS ik, i.b AS it, i.distance AS id, o.key AS ok, o.b AS ot, o.distance AS od,
    {distance_sql("w.b", "i.b")} AS dwi, {distance_sql("w.b", "o.b")} AS dwo, {distance_sql("i.b", "o.b")} AS dio
  FROM pairs p JOIN told_p w ON w.a = p.a AND w.b = p.b JOIN told_p i ON i.a = p.a AND i.b = p.it JOIN told_p o ON o.a = p.a AND o.b = p.ot
), met_p AS MATERIALIZED (SELECT wk AS xk, ik AS yk FROM joined UNION SELECT wk, ok FROM joined UNION SELECT ik, ok FROM joined
), one_p AS MATERIALIZED (SELECT xk, yk, pos, symbol FROM met_p JOIN units_p ON key = xk
), shared_p AS MATERIALIZED (SELECT DISTINCT xk, yk FROM one_p o JOIN units_p v ON v.key = o.yk AND v.pos = o.pos AND v.symbol = o.symbol
), named AS (SELECT a, b, subtrahend_hgvs, remainder_hgvs, {_relate("w", "i")} AS with_subtrahend, {_relate("w", "o")} AS with_remainder, {_relate("i", "o")} AS "between" FROM joined)
SELECT n.key, subtrahend_hgvs, remainder_hgvs, with_subtrahend, with_remainder, "between" FROM names n JOIN named d ON d.a = n.a AND d.b = n.b"""


def _interleaved(source: str, key: str) -> str:
    """The ways of each edit of `source` (key columns, vstart, vend, seq) as single deletions and insertions: a step puts or deletes one symbol."""
    return f"""turns AS (
  SELECT {key}, vstart, vend, seq, CAST(0 AS BIGINT) AS gone, CAST(0 AS BIGINT) AS put, '' AS last, CAST([] AS VARCHAR[]) AS texts FROM {source}
  UNION ALL
  SELECT {key}, vstart, vend, seq, gone + (1 - ins), put + ins, CASE ins WHEN 1 THEN '0' ELSE '1' END,
    CASE WHEN ins = 0 THEN list_append(texts, concat(vstart + gone, ':', vstart + gone + 1, '/'))
         WHEN last = '0' THEN list_append(texts[1:len(texts) - 1], concat(texts[len(texts)], substr(seq, CAST(put + 1 AS INT), 1)))
         ELSE list_append(texts, concat(vstart + gone, ':', vstart + gone, '/', substr(seq, CAST(put + 1 AS INT), 1))) END
  FROM turns, (VALUES (CAST(0 AS BIGINT)), (CAST(1 AS BIGINT))) t(ins) WHERE CASE ins WHEN 1 THEN put < length(seq) ELSE gone < vend - vstart END
)"""


ATOMIC_STEPS = NAMES + ", " + _interleaved("edits_of", "key, pr, pc, qr, qc") + " SELECT key, pr AS row, pc AS col, array_to_string(texts, ';') AS edits FROM turns WHERE gone = vend - vstart AND put = length(seq)"

#: What is told of the alleles that make b of a: canonical forms, spanning edits, distances.
_EXTRACTED = RECURSIVE + ", " + _of_pairs("names", "_p").lstrip(" ,") + f""", {_fewest("cheap_p", "rank = -1", "+")}, {_fewest("dear_p", "rank = (SELECT l FROM sizes_p z WHERE z.key = cells_p.key)", "-")}, kept_p AS (
  SELECT x.key, x.rank, x.r, x.c FROM cheap_p x JOIN dear_p y ON y.key = x.key AND y.rank = x.rank AND y.r = x.r AND y.c = x.c QUALIFY x.cost + y.cost = min(x.cost + y.cost) OVER (PARTITION BY x.key)
), variants AS (
  SELECT id, vstart, vend, seq, substr(a, CAST(vstart + 1 AS INT), CAST(vend - vstart AS INT)) AS old FROM (
    SELECT o.key AS id, s.a, lag(r) OVER w + 1 AS vstart, r AS vend, substr(s.b, CAST(lag(c) OVER w + 2 AS INT), CAST(c - lag(c) OVER w - 1 AS INT)) AS seq
    FROM (SELECT key, rank, min(r) AS r, min(c) AS c FROM kept_p GROUP BY key, rank HAVING count(*) = 1) o JOIN sizes_p s ON s.key = o.key WINDOW w AS (PARTITION BY o.key ORDER BY rank)
  ) WHERE vstart IS NOT NULL AND (vstart < vend OR seq <> '')
), {_TEXTS.replace("range(0, 7000)", "range(0, 40)")}, extracted AS (
  SELECT s.key, CAST(s.n + s.m - 2 * s.l AS BIGINT) AS distance, CASE coalesce(t.n, 0) WHEN 0 THEN '=' WHEN 1 THEN all_of ELSE concat('[', all_of, ']') END AS hgvs,
    coalesce(low, 0) AS vstart, coalesce(high, 0) AS vend, CASE WHEN low IS NULL THEN '' ELSE substr(s.b, CAST(low + 1 AS INT), CAST(high + s.m - s.n - low AS INT)) END AS seq
  FROM sizes_p s LEFT JOIN (SELECT id, count(*) AS n, string_agg(text, ';' ORDER BY vstart) AS all_of FROM texts GROUP BY id) t ON t.id = s.key
  LEFT JOIN (SELECT key, min(vstart) AS low, max(vend) AS high FROM edits_of_p GROUP BY key) e ON e.key = s.key
)"""
EXTRACTED = _EXTRACTED + " SELECT key, distance, hgvs, concat(vstart, ':', vend, '/', seq) AS supremal FROM extracted"
REPORT = _EXTRACTED + " SELECT concat(key, ' ', key, ':g.', hgvs, ' ', key, ':', vstart, ':', vend - vstart, ':', seq) AS line FROM extracted"
ATOMS_DISJOINT = _sides() + " SELECT key, key NOT IN (SELECT key FROM shared) AS is_disjoint FROM names"

RICH_HGVS = SQL + """, shown AS (
  SELECT *, substr(sequence, CAST(vstart + 1 AS INT), CAST(vend - vstart AS INT)) AS old, substr(sequence, CAST(vstart + 1 AS INT), 1) AS one, CASE WHEN vend - vstart = 1 THEN CAST(vend AS VARCHAR) ELSE concat(vstart + 1, '_', vend) END AS place
  FROM edits JOIN dna USING (ref_id) WHERE vend > vstart
), kinds AS (
  SELECT *, (vstart + vend) % 7 AS kind, length(sequence) - vstart - length(ltrim(substr(sequence, CAST(vstart + 1 AS INT)), one)) AS copies FROM shown
)
SELECT ref_id, CASE kind WHEN 0 THEN concat(place, 'dup', CASE WHEN seq = '' THEN old ELSE '' END) WHEN 1 THEN concat('x:g.', place, 'inv') WHEN 2 THEN concat(place, CASE WHEN seq = '' THEN '' ELSE old END, '=')
    WHEN 3 THEN concat(place, 'delins[A', seq, '[2];C[3]]') WHEN 4 THEN concat(CASE WHEN vend - vstart = 1 THEN concat(vend, '_', vend + 1) ELSE place END, 'G', seq, '[3]') WHEN 5 THEN concat(vstart + 1, one, '[4]') ELSE concat('[', length(sequence) + 1, '_', length(sequence) + 2, '=;', place, 'del', old, 'ins', seq, 'T]') END AS text,
  CASE kind WHEN 0 THEN concat(vstart, ':', vend, '/', old, old) WHEN 1 THEN concat(vstart, ':', vend, '/', reverse(translate(old, 'ACGT', 'TGCA'))) WHEN 2 THEN ''
    WHEN 3 THEN concat(vstart, ':', vend, '/A', seq, 'A', seq, 'CCC') WHEN 4 THEN CASE WHEN vend - vstart = 1 AND vend + 1 > length(sequence) THEN 'ValueError' ELSE concat(CASE WHEN vend - vstart = 1 THEN vend - 1 ELSE vstart END, ':', CASE WHEN vend - vstart = 1 THEN vend + 1 ELSE vend END, '/G', seq, 'G', seq, 'G', seq) END
    WHEN 5 THEN concat(vstart, ':', vstart + copies, '/', repeat(one, 4)) ELSE concat(vstart, ':', vend, '/', seq, 'T') END AS edits
FROM kinds"""

"""DuckDB SQL with the same results as the registered queries, where SQL over whole tables is feasible.

PageRank and what fuses it, the passage accumulator and what builds on it, the flat map and the
streaming query have none: tests compare them with brute force.  Recursion stands for greedy choices:
each step's rows are a group's members with what the choices so far leave of them.
"""

from __future__ import annotations

#: Fixed values, written out here so that the SQL stands for itself: function words, phrases of front matter, colours.
_STOP = ", ".join(
    f"'{w}'"
    for w in """
a an the and or but nor so yet if then than as of in on at to from by for with
without into onto upon over under between through about above below after before
is are was were be been am do does did have has had having not no it its this
that these those there here which who whom whose what when where why how i we you
he she they them us our your his her their my me him can could may might must shall
should will would also too very more most such each any all both either
""".split()
)
_CONCEPT_STOP = ", ".join(
    f"'{w}'"
    for w in """
a an the this that these those it its is are was were be been being am do does did
of in on at to from by for with without into onto upon over under between
and or but nor so yet as if then than which who whom whose what when where why how
not no only just also too very more most much many few less least own same other
i we you he she they them us our your his her their my me him there here thus
can could may might must shall should will would have has had having
one two three first second new way thing things make made makes making see seen
such about above below after before again further once each any all both either
say said says according e.g i.e cf ed eds vol pp p chapter section page note notes
text passage author work however therefore moreover indeed rather merely simply
some now because even still since like cannot whether another always never every kind
already precisely case fact find know mean means course order terms press university
die der later together through possible everything view beyond remains ourselves
himself themselves people basis different lecture lectures york cambridge well longer
taken instead concerning away great today translation oxford london
""".split()
)
SIGNALS = (
    "no part of this book", "all rights reserved", "library of congress", "cataloging-in-publication",
    "manufactured in the united states", "printed in the united states", "university press", "isbn", "p. cm",
    "intentionally omitted", "this book is a publication", "permission in writing from the publisher",
)
PALETTE = {
    "amber": (0.957, 0.851, 0.545),
    "rose": (0.949, 0.722, 0.690),
    "sage": (0.737, 0.839, 0.675),
    "sky": (0.663, 0.796, 0.878),
    "violet": (0.792, 0.737, 0.878),
}
_V = """v AS (SELECT vec_id AS id, 'b' || label AS book_id, embedding::DOUBLE[] AS e, list_reverse(embedding)::DOUBLE[] AS s FROM embeddings)"""
_SIM = f"""{_V}, sim AS (
  SELECT a.id AS seed_id, b.id, a.book_id AS seed_book, b.book_id, list_dot_product(a.e, b.e) AS x, list_dot_product(a.s, b.s) AS y FROM v a JOIN v b ON TRUE
)"""
_PLAIN = f"""{_SIM}, plain AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY seed_id ORDER BY x DESC, id) AS pos FROM sim WHERE id <> seed_id) WHERE pos <= 50
)"""
_STRUCT = """structural AS (SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY seed_id ORDER BY y DESC, id) AS pos FROM sim
  WHERE id <> seed_id AND book_id <> seed_book AND y >= 0.20 AND y < 0.97) WHERE pos <= 8)"""
_MARKS = """m AS (
  SELECT doc_id AS target, toxic = 1 AS orphaned, text AS quote,
    list_concat(e[2:], e[1:1]) AS e FROM labels JOIN documents USING (doc_id) JOIN v ON v.id = doc_id
), marked AS (SELECT * FROM (
  SELECT v.id AS seed_id, target AS id, list_dot_product(v.e, m.e) AS x,
    row_number() OVER (PARTITION BY v.id ORDER BY list_dot_product(v.e, m.e) DESC, target) AS pos
  FROM v JOIN m ON v.id <> target WHERE NOT orphaned AND quote <> '' AND list_dot_product(v.e, m.e) >= 0.25) WHERE pos <= 8)"""
_BAND = """band AS (SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY seed_id ORDER BY x DESC, id) AS pos FROM sim
  WHERE x < 0.97 AND x >= 0.15 AND book_id <> seed_book) WHERE pos BETWEEN 9 AND 128)"""
_TOK = rf"""tok AS (
  SELECT doc_id AS id, source AS book_id, list_filter(
    list_transform(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+'), lambda w: regexp_replace(w, '^_+|_+$', '', 'g')),
    lambda w: length(w) > 1 AND NOT regexp_full_match(w, '[0-9]+') AND NOT list_contains([{_STOP}], w)) AS t FROM documents
), p AS (SELECT id, book_id, term, count(*) AS tf, any_value(dl) AS dl FROM (SELECT id, book_id, len(t) AS dl, unnest(t) AS term FROM tok) GROUP BY ALL
), st AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM tok
), df AS (SELECT term, count(*) AS df FROM p GROUP BY term
), idf AS (SELECT term, ln(1 + (n - df + 0.5) / (df + 0.5)) AS idf, avgdl FROM df, st
), dt AS (SELECT * FROM (
  SELECT id, term, round(tf * idf, 6) AS weight, row_number() OVER (PARTITION BY id ORDER BY round(tf * idf, 6) DESC, term) AS pos FROM p JOIN idf USING (term))
  WHERE pos <= 12)"""
_BM25 = """bm AS (
  SELECT q.seed_id, p.id, p.book_id, round(sum(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score, count(*) AS n_terms
  FROM q JOIN idf USING (term) JOIN p USING (term) GROUP BY ALL HAVING score > 0)"""
_THEME = rf"""q AS (SELECT DISTINCT item_id AS seed_id, unnest(list_filter(
    list_transform(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+'), lambda w: regexp_replace(w, '^_+|_+$', '', 'g')),
    lambda w: length(w) > 1 AND NOT regexp_full_match(w, '[0-9]+') AND NOT list_contains([{_STOP}], w))) AS term FROM benchmark)"""
_ANY_TOP = """lx AS (SELECT * FROM (
  SELECT bm.*, row_number() OVER (PARTITION BY seed_id ORDER BY score DESC, bm.id) AS pos FROM bm WHERE seed_id <> bm.id) WHERE pos <= 50)"""
_CHUNK_TOP = """lx AS (SELECT * FROM (
  SELECT bm.*, row_number() OVER (PARTITION BY seed_id ORDER BY score DESC, bm.id) AS pos
  FROM bm JOIN documents d ON d.doc_id = seed_id WHERE seed_id <> bm.id AND d.source <> bm.book_id) WHERE pos <= 50)"""
_CONCEPT = rf"""ct AS (
  SELECT doc_id AS id, list_filter(regexp_extract_all(lower(text), '[a-zà-ÿ][a-zà-ÿ''\-]{{2,}}'),
    lambda w: NOT contains(w, '''') AND NOT list_contains([{_CONCEPT_STOP}], w)) AS t FROM documents
), g AS (
  SELECT id, gram, count(*) AS tf FROM (
    SELECT id, unnest(list_concat(t, list_transform(range(1, greatest(len(t), 1)::BIGINT), lambda i: t[i] || ' ' || t[i + 1]))) AS gram FROM ct) GROUP BY ALL
), gd AS (
  SELECT gram, count(*) AS df, any_value(n) AS n FROM g, (SELECT count(*) AS n FROM documents) GROUP BY gram
  HAVING count(*) >= 3 AND count(*) <= greatest(4, floor(0.40 * any_value(n)))
), gw AS (SELECT id, gram, tf * ln(n / df) AS w FROM g JOIN gd USING (gram)
), voc AS (SELECT gram, round(sum(w), 6) AS mass FROM gw GROUP BY gram ORDER BY mass DESC, gram LIMIT 160
), cc AS (SELECT id, pos, gram AS label FROM (
  SELECT id, gram, row_number() OVER (PARTITION BY id ORDER BY round(w, 6) DESC, gram DESC) AS pos FROM gw JOIN voc USING (gram)) WHERE pos <= 6)"""
_LOG = """ev AS (
  SELECT user_id AS book, (ts::DATE - (date_diff('day', DATE '1970-01-01', ts::DATE) % 10)::INT)::DATE AS session, epoch_us(ts) AS t, event_id, (props::JSON ->> '$.k')::BIGINT AS passage,
    CASE event_type WHEN 'view' THEN 'enter' WHEN 'purchase' THEN 'exit' WHEN 'click' THEN 'select' WHEN 'error' THEN 'idle' WHEN 'signup' THEN 'active' END AS type, value >= 100 AS highlighted
  FROM events
), wd AS (SELECT doc_id AS passage, len(regexp_extract_all(text, '\\S+')) AS words FROM documents)"""


def _rhythm(by: str, source: str, x: str) -> str:
    """Features of `source`, a log, for each of `by`; names end in `x`."""
    return f"""vis{x} AS (
  SELECT * FROM (SELECT {by}, passage, type, event_id, t AS a, coalesce(lead(t) OVER (PARTITION BY {by} ORDER BY t, event_id), t) AS b
    FROM {source} WHERE type IN ('enter', 'exit')) WHERE type = 'enter'
), sp{x} AS (
  SELECT {by}, t AS f, u FROM (
    SELECT {by}, type, t, lag(type) OVER w AS before,
      min(CASE WHEN type = 'active' THEN t END) OVER (PARTITION BY {by} ORDER BY t, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS u
    FROM {source} WHERE type IN ('idle', 'active') WINDOW w AS (PARTITION BY {by} ORDER BY t, event_id))
  WHERE type = 'idle' AND before IS DISTINCT FROM 'idle' AND u IS NOT NULL
), lost{x} AS (SELECT event_id, sum(least(b, u) - greatest(a, f)) AS lost FROM vis{x} JOIN sp{x} USING ({by}) WHERE f < b AND u > a GROUP BY event_id
), held{x} AS (SELECT {by}, passage, a, event_id, greatest(0.0, (b - a - coalesce(lost, 0)) / 1000.0) AS ms FROM vis{x} LEFT JOIN lost{x} USING (event_id)
), ft{x} AS (
  SELECT h.*, h.attentive_ms / greatest(1, coalesce(words, 1)) AS ms_per_word, h.first_ms / greatest(1, coalesce(words, 1)) AS first_pass_ms_per_word,
    coalesce(selections, 0) AS selections, coalesce(plain, false) AS selected_not_highlighted
  FROM (SELECT {by}, passage, sum(ms) AS attentive_ms, count(*) - 1 AS revisits, max(ms) AS max_dwell_ms, arg_min(ms, (a, event_id)) AS first_ms FROM held{x} GROUP BY ALL) h
  LEFT JOIN (SELECT {by}, passage, count(*) AS selections, bool_or(NOT highlighted) AS plain FROM {source} WHERE type = 'select' GROUP BY ALL) s USING ({by}, passage) LEFT JOIN wd USING (passage))"""


_EV = f"{_LOG}, {_rhythm('book', 'ev', '')}"
_BASE = """seen AS (SELECT * FROM ft WHERE attentive_ms >= 1500
), md AS (SELECT book, quantile_cont(ms_per_word, 0.5) AS med, count(*) AS n, stddev_pop(ms_per_word) AS std FROM seen GROUP BY book
), ma AS (SELECT book, quantile_cont(abs(ms_per_word - med), 0.5) AS mad FROM seen JOIN md USING (book) GROUP BY book
), base AS (SELECT book, med, CASE WHEN mad > 0 THEN mad WHEN std > 0 THEN std ELSE 1.0 END AS spread, n, n >= 8 AS have_baseline FROM md JOIN ma USING (book) WHERE n >= 3)"""


def _scored(source: str, name: str) -> str:
    return f"""{name} AS (
  SELECT *, (z >= 1.0 AND attentive_ms >= 1500)::INT + (revisits > 0)::INT + selected_not_highlighted::INT >= 2 AS hotspot FROM (
    SELECT *, round(0.6745 * (attentive_ms / (attentive_ms + 9000) * ms_per_word + (1 - attentive_ms / (attentive_ms + 9000)) * med - med) / spread, 6) AS z
    FROM {source} JOIN base USING (book)))"""


_SC = f"{_BASE}, {_scored('ft', 'sc')}"
_HITS = " + ".join(f"contains(low, '{s}')::INT" for s in SIGNALS)
_PROSE = r"""CASE WHEN len(w) > 0 THEN len(list_filter(w, lambda x: length(regexp_replace(x, '[^\p{L}]', '', 'g')) >= 2 AND NOT regexp_matches(x, '[0-9]'))) / len(w) ELSE 0.0 END"""
_HELD = """h AS (SELECT item_id AS quote_id, doc_id AS book_id, b.text AS quote, d.text FROM benchmark b JOIN documents d ON contains(d.text, b.text))"""

def _accumulated(x: str, target: int, overlap: int) -> str:
    """Greedy passages `pa{x}` (book_id, n, words, body, start, end) over the lines `li` of documents.

    Words up to a line stand for places: a run is the lines between two counts.  Each step reads one line; a cut moves the
    run's start to the last line from which `overlap` words are held.  Then places are found from where the last one was.
    """
    return rf"""ca{x} AS (
  SELECT a.book_id, a.i, max(b.upto - b.words) AS tail FROM li a JOIN li b ON a.book_id = b.book_id AND b.kind = 'para' AND b.i <= a.i AND b.upto - b.words <= a.upto - {overlap} GROUP BY ALL
), st{x} AS (SELECT li.book_id, li.i, li.kind, li.upto, li.total, coalesce(tail, 0) AS tail, CASE WHEN li.kind = 'para' THEN {target} ELSE {target // 2} END AS most FROM li LEFT JOIN ca{x} USING (book_id, i)
), ru{x} AS (
  SELECT book_id, 0::BIGINT AS i, 0::BIGINT AS base, NULL::BIGINT AS low, NULL::BIGINT AS high FROM st{x} WHERE i = 1
  UNION ALL SELECT s.book_id, s.i, CASE WHEN s.upto - r.base >= most THEN greatest(r.base, s.tail) ELSE r.base END,
    CASE WHEN s.upto - r.base >= most THEN r.base END, CASE WHEN s.upto - r.base >= most THEN s.upto END
  FROM ru{x} r JOIN st{x} s ON s.book_id = r.book_id AND s.i = r.i + 1
), cu{x} AS (
  SELECT book_id, i, low, high FROM ru{x} WHERE high - low >= 60
  UNION ALL SELECT book_id, i + 1, base, total FROM (SELECT r.*, s.total FROM ru{x} r JOIN st{x} s USING (book_id, i) QUALIFY row_number() OVER (PARTITION BY book_id ORDER BY i DESC) = 1) WHERE total - base >= 60
), bo{x} AS (
  SELECT c.book_id, c.i, c.high - c.low AS words, string_agg(l.x, chr(10) || chr(10) ORDER BY l.i) AS body, arg_min(l.x, l.i) AS head, arg_max(l.x, l.i) AS foot
  FROM cu{x} c JOIN li l ON l.book_id = c.book_id AND l.kind = 'para' AND l.upto > c.low AND l.upto <= c.high GROUP BY ALL
), ke{x} AS (
  SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY i) - 1 AS n FROM (
    SELECT *, {_HITS} AS hits, {_PROSE} AS prose FROM (SELECT *, lower(body) AS low, regexp_extract_all(body, '\S+') AS w FROM bo{x}))
  WHERE NOT ((contains(low, 'intentionally omitted') AND length(body) < 600) OR hits >= 2 OR (hits >= 1 AND prose < 0.65) OR prose < 0.5)
), pl{x} AS (
  SELECT k.book_id, 0::BIGINT AS n, (instr(text, head) - 1)::BIGINT AS start FROM ke{x} k JOIN documents ON doc_id = book_id WHERE k.n = 0
  UNION ALL SELECT k.book_id, k.n, (CASE WHEN instr(substr(text, p.start + 2), head) > 0 THEN p.start + instr(substr(text, p.start + 2), head) ELSE instr(text, head) - 1 END)::BIGINT
  FROM pl{x} p JOIN ke{x} k ON k.book_id = p.book_id AND k.n = p.n + 1 JOIN documents ON doc_id = k.book_id
), pa{x} AS (
  SELECT k.book_id, k.n, k.words, k.body, p.start, CASE WHEN instr(substr(text, p.start + 1), foot) > 0 THEN p.start + instr(substr(text, p.start + 1), foot) - 1 + length(foot) END AS stop
  FROM ke{x} k JOIN pl{x} p USING (book_id, n) JOIN documents ON doc_id = k.book_id)"""


_LINES = r"""li AS (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY pos) AS i, sum(words) OVER (PARTITION BY book_id ORDER BY pos)::BIGINT AS upto, sum(words) OVER (PARTITION BY book_id)::BIGINT AS total FROM (
  SELECT book_id, pos, x, kind, CASE WHEN kind = 'para' THEN len(regexp_extract_all(x, '\S+')) ELSE 0 END AS words FROM (
    SELECT *, CASE WHEN regexp_full_match(x, '#{1,6} .*') THEN 'heading' ELSE 'para' END AS kind FROM (
      SELECT doc_id AS book_id, trim(unnest(string_split(text, chr(10)))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents) WHERE x <> '')
  WHERE NOT regexp_full_match(x, '<!--\s*page\s+\d+\s*-->')))"""
_SMALL = f"{_LINES}, {_accumulated('', 240, 40)}"

def _placed(points: str) -> str:
    """`placed` (id, x, y): points (id, e) on their two main axes.

    A matrix squared often enough is all its main axis; what that axis explains is taken out for the next.  An axis points to
    its largest part.
    """
    cells = f"""cell AS MATERIALIZED (SELECT id, unnest(e)::DOUBLE AS v, generate_subscripts(e, 1) AS i FROM {points}
), mu AS MATERIALIZED (SELECT i, avg(v) AS m FROM cell GROUP BY i
), cov0 AS MATERIALIZED (SELECT a.i, b.i AS j, avg((a.v - p.m) * (b.v - q.m)) AS v FROM cell a JOIN cell b USING (id) JOIN mu p ON p.i = a.i JOIN mu q ON q.i = b.i GROUP BY ALL)"""
    for axis in range(2):
        cells += f", s{axis}_0 AS MATERIALIZED (SELECT i, j, v / (SELECT sum(v) FROM cov{axis} WHERE i = j) AS v FROM cov{axis})"
        for k in range(14):
            cells += f""", r{axis}_{k} AS MATERIALIZED (SELECT a.i, b.j, sum(a.v * b.v) AS v FROM s{axis}_{k} a JOIN s{axis}_{k} b ON a.j = b.i GROUP BY ALL)
, s{axis}_{k + 1} AS MATERIALIZED (SELECT i, j, v / (SELECT sum(v) FROM r{axis}_{k} WHERE i = j) AS v FROM r{axis}_{k})"""
        cells += f""", u{axis} AS MATERIALIZED (SELECT j AS i, v / sqrt((SELECT max(v) FROM s{axis}_14 WHERE i = j)) AS v FROM s{axis}_14 WHERE i = (SELECT arg_max(i, v) FROM s{axis}_14 WHERE i = j)
), ax{axis} AS MATERIALIZED (SELECT i, v * sign((SELECT arg_max(v, abs(v)) FROM u{axis})) / sqrt((SELECT sum(v * v) FROM u{axis})) AS v FROM u{axis}
), la{axis} AS MATERIALIZED (SELECT sum(a.v * c.v * b.v) AS l FROM ax{axis} a JOIN cov{axis} c ON c.i = a.i JOIN ax{axis} b ON b.i = c.j
), cov{axis + 1} AS MATERIALIZED (SELECT c.i, c.j, c.v - (SELECT l FROM la{axis}) * a.v * b.v AS v FROM cov{axis} c JOIN ax{axis} a ON a.i = c.i JOIN ax{axis} b ON b.i = c.j)"""
    return cells + """, placed AS MATERIALIZED (SELECT id, sum((c.v - m) * ax0.v) AS x, sum((c.v - m) * ax1.v) AS y FROM cell c JOIN mu USING (i) JOIN ax0 USING (i) JOIN ax1 USING (i) GROUP BY id
), square AS MATERIALIZED (SELECT id, round((x - min(x) OVER ()) / (max(x) OVER () - min(x) OVER ()) * 1000, 1) AS x, round((y - min(y) OVER ()) / (max(y) OVER () - min(y) OVER ()) * 1000, 1) AS y FROM placed)"""


_LEVELS = """bk AS (SELECT book_id, list(m ORDER BY i) AS e FROM (SELECT book_id, i, avg(x) AS m FROM (SELECT book_id, unnest(e) AS x, generate_subscripts(e, 1) AS i FROM v) GROUP BY ALL) GROUP BY book_id
), un AS MATERIALIZED (
  SELECT 'chunk' AS level, id, CASE WHEN id % 10 < 9 THEN 1000000000 + substr(book_id, 2)::BIGINT ELSE -1 END AS parent_id, book_id, e FROM v
  UNION ALL SELECT 'parent', 1000000000 + substr(book_id, 2)::BIGINT, NULL, book_id, e FROM bk)"""

_KNOWN = """hashed AS (SELECT doc_id, text, sha256(text) AS h FROM documents), known AS (SELECT DISTINCT h FROM hashed JOIN labels USING (doc_id))"""
_COLOURS = ", ".join(f"{{'d': (r - {r}) * (r - {r}) + (g - {g}) * (g - {g}) + (b - {b}) * (b - {b}), 'i': {i}, 'name': '{n}'}}" for i, (n, (r, g, b)) in enumerate(PALETTE.items()))

_CLIP = lambda x, n: f"CASE WHEN length({x}) > {n} THEN rtrim(substr({x}, 1, {n - 1})) || '…' ELSE {x} END"
_SECTIONS = r"""u AS (
        SELECT source AS book_id, doc_id AS id, len(regexp_extract_all(text, '\S+')) AS words, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents
      ), r AS (
        SELECT book_id, k, id, words, 0 AS section, words AS held FROM u WHERE k = 1
        UNION ALL SELECT u.book_id, u.k, u.id, u.words, CASE WHEN r.held >= 1000 THEN r.section + 1 ELSE r.section END, CASE WHEN r.held >= 1000 THEN u.words ELSE r.held + u.words END
        FROM r JOIN u ON u.book_id = r.book_id AND u.k = r.k + 1)"""

def _mmr(pool: str, weight: float, k: int = 8) -> str:
    """`mmr` (seed_id, id, step, x, score): the greedy choice out of `pool` (seed_id, id, pos, x)."""
    return f"""mr AS (
      SELECT 0 AS step, seed_id, p.id, pos, x, e, NULL::DOUBLE AS near, false AS picked, NULL::DOUBLE AS score FROM {pool} p JOIN v USING (id)
      UNION ALL SELECT step + 1, seed_id, id, pos, x, e, greatest(near, list_dot_product(e, be)), id = bid, s FROM (
        SELECT *, first_value(id) OVER w AS bid, first_value(e) OVER w AS be FROM (
          SELECT *, {weight} * x - coalesce((1 - {weight}) * near, 0) AS s FROM mr WHERE NOT picked AND step < {k})
        WINDOW w AS (PARTITION BY seed_id ORDER BY s DESC, pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
    ), mmr AS (SELECT seed_id, id, step, x, score FROM mr WHERE picked)"""


_BAND_V = f"{_SIM}, {_BAND}, bd AS MATERIALIZED (SELECT seed_id, id, pos, x FROM band)"
_COVERS = """cv AS (
  SELECT seed_id, id, count(other) AS covers, any_value(size) AS band_size FROM (
    SELECT pk.seed_id, pk.id, o.id AS other, (SELECT count(*) FROM bd WHERE bd.seed_id = pk.seed_id) AS size,
      row_number() OVER (PARTITION BY pk.seed_id, o.id ORDER BY list_dot_product(a.e, b.e) DESC, pk.step) AS r
    FROM pk JOIN v a ON a.id = pk.id LEFT JOIN (SELECT * FROM bd ANTI JOIN pk USING (seed_id, id)) o ON o.seed_id = pk.seed_id LEFT JOIN v b ON b.id = o.id)
  WHERE r = 1 OR other IS NULL GROUP BY ALL)"""
_SPREAD_OUT = """SELECT pk.seed_id, pk.id, pk.step::INT AS pos, round(pk.x, 6) AS similarity, round(pk.score, 6) AS score, coalesce(covers, 0)::BIGINT AS covers,
  (SELECT count(*) FROM bd WHERE bd.seed_id = pk.seed_id)::INT AS band_size FROM pk LEFT JOIN cv USING (seed_id, id)"""
_DPP = """dp AS (
  SELECT 0 AS step, seed_id, b.id, pos, x, list_transform(e, lambda t: t * exp(3 * round(x, 4))) AS rest, false AS picked, NULL::DOUBLE AS score FROM bd b JOIN v USING (id)
  UNION ALL SELECT step + 1, seed_id, id, pos, x,
    list_transform(list_zip(rest, br), lambda t: t[1] - t[2] * d), id = bid, ln(bl) FROM (
    SELECT *, list_dot_product(rest, br) / bl AS d FROM (
      SELECT *, first_value(id) OVER w AS bid, first_value(rest) OVER w AS br, first_value(l) OVER w AS bl FROM (
        SELECT *, list_dot_product(rest, rest) AS l FROM dp WHERE NOT picked AND step < 8)
      WINDOW w AS (PARTITION BY seed_id ORDER BY l DESC, pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) WHERE bl > 1e-10)
), pk AS (SELECT seed_id, id, step, x, score FROM dp WHERE picked)"""
_FACILITY = """gr AS MATERIALIZED (
  SELECT a.seed_id, a.id AS i, b.id AS j, list_dot_product(va.e, vb.e) AS c FROM bd a JOIN bd b ON a.seed_id = b.seed_id JOIN v va ON va.id = a.id JOIN v vb ON vb.id = b.id
), fl AS (
  SELECT 0 AS step, seed_id, id, pos, x, 0.0::DOUBLE AS held, false AS picked, NULL::DOUBLE AS score, false AS fresh FROM bd
  UNION ALL SELECT step + 1, seed_id, id, pos, x, greatest(held, c), picked OR id = bid, CASE WHEN id = bid THEN gain END, id = bid FROM (
    SELECT f.*, w.bid, w.gain, gr.c FROM (SELECT * FROM fl WHERE step < 8) f JOIN (
      SELECT seed_id, arg_min(i, (-g, pos)) AS bid, max(g) AS gain FROM (
        SELECT o.seed_id, o.id AS i, o.pos, round(sum(greatest(gr.c - m.held, 0)), 12) AS g FROM (SELECT * FROM fl WHERE NOT picked) o
        JOIN gr ON gr.seed_id = o.seed_id AND gr.j = o.id JOIN fl m ON m.seed_id = o.seed_id AND m.id = gr.i GROUP BY ALL) GROUP BY seed_id) w USING (seed_id)
    JOIN gr ON gr.seed_id = f.seed_id AND gr.i = f.id AND gr.j = w.bid)
), pk AS (SELECT seed_id, id, step, x, score FROM fl WHERE fresh)"""
_ECHO = """pl AS (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY id) AS place FROM v), ec AS MATERIALIZED (SELECT * FROM (
  SELECT a.id AS seed_id, b.id, abs(a.place - b.place) AS distance, list_dot_product(a.e, b.e) AS x,
    row_number() OVER (PARTITION BY a.id ORDER BY list_dot_product(a.e, b.e) DESC, b.id) AS pos
  FROM pl a JOIN pl b ON a.book_id = b.book_id AND abs(a.place - b.place) >= 12 WHERE list_dot_product(a.e, b.e) >= 0 AND list_dot_product(a.e, b.e) < 0.97) WHERE pos <= 120)"""
_WALK = """wk AS (
  SELECT 0 AS hop, id AS seed_id, id, e, [book_id] AS books, NULL::BIGINT AS from_id, NULL::DOUBLE AS h FROM v
  UNION ALL SELECT hop + 1, seed_id, id, e, list_append(books, book_id), was, d FROM (
    SELECT wk.hop, wk.seed_id, v.id, v.e, wk.books, v.book_id, wk.id AS was, list_dot_product(wk.e, v.e) AS d,
      row_number() OVER (PARTITION BY wk.seed_id ORDER BY list_dot_product(wk.e, v.e) DESC, v.id) AS k
    FROM wk JOIN v ON NOT list_contains(wk.books, v.book_id) WHERE wk.hop < 4 AND list_dot_product(wk.e, v.e) >= 0.15 AND list_dot_product(wk.e, v.e) < 0.97) WHERE k = 9)"""

ORACLE_SQL = {
    "band_mmr": f"WITH RECURSIVE {_BAND_V}, {_mmr('bd', 0.4)} SELECT seed_id, id, step::INT AS pos, round(x, 6) AS similarity, round(score, 6) AS score FROM mmr",
    "spread_dpp": f"WITH RECURSIVE {_BAND_V}, {_DPP}, {_COVERS} {_SPREAD_OUT}",
    "spread_facility": f"WITH RECURSIVE {_BAND_V}, {_FACILITY}, {_COVERS} {_SPREAD_OUT}",
    "echo": f"WITH RECURSIVE {_V}, {_ECHO}, {_mmr('ec', 0.6)} SELECT seed_id, id, step::INT AS pos, round(x, 6) AS similarity, round(score, 6) AS score FROM mmr",
    "walk": f"""WITH RECURSIVE {_V}, {_WALK} SELECT seed_id, wk.id, hop::INT AS hop, round(list_dot_product(wk.e, s.e), 6) AS similarity, round(h, 6) AS hop_similarity, from_id
        FROM wk JOIN v s ON s.id = seed_id WHERE hop > 0""",
    "note_records": r"""WITH c AS (SELECT conv_id * 1000 + turn AS note_id, text, role FROM conversations)
        SELECT note_id, 0::INT AS n, 'sutra' AS type, 'seed' AS role, regexp_replace(text, '^\s+|\s+$', '', 'g') AS text, false AS inline, NULL::INT AS parent FROM c
        UNION ALL SELECT note_id, 1, 'correlate', 'edge', role, true, NULL FROM c""",
    "note_edges": r"""WITH c AS (SELECT conv_id, turn, text, CASE WHEN role = 'assistant' THEN 'edge' WHEN turn % 3 = 0 THEN 'seed' ELSE 'voice' END AS role FROM conversations WHERE text IS NOT NULL),
      s AS (SELECT *, last_value(CASE WHEN role = 'seed' AND text <> '' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seed FROM c),
      e AS (SELECT *, rtrim(coalesce(nullif(regexp_extract(trim(text), '(?s)^(.*?[.!?])(?:\s|$)', 1), ''), trim(text))) AS label FROM s WHERE role = 'edge' AND text <> '')
      SELECT CASE WHEN length(seed) > 80 THEN substr(seed, 1, 80) || '…' ELSE coalesce(seed, conv_id::VARCHAR) END AS source, CASE WHEN length(label) > 80 THEN rtrim(substr(label, 1, 79)) || '…' ELSE label END AS target,
        'correlate' AS relation, trim(regexp_replace(text, '\s+', ' ', 'g')) AS text, printf('%d#a%03d', conv_id, turn) AS provenance, 'note' AS origin FROM e""",
    "book_of_import": r"""WITH q AS (SELECT item_id // 5 AS import_id, trim(regexp_replace(lower(text), '\s+', ' ', 'g')) AS quote FROM benchmark), b AS (SELECT doc_id AS book_id, trim(regexp_replace(lower(text), '\s+', ' ', 'g')) AS text FROM documents),
      s AS (SELECT import_id, book_id, count(*) AS hits, sum(length(quote))::BIGINT AS weight FROM q JOIN b ON contains(text, quote) WHERE quote <> '' GROUP BY ALL)
      SELECT import_id, book_id, hits, weight FROM s QUALIFY row_number() OVER (PARTITION BY import_id ORDER BY hits DESC, weight DESC, book_id) = 1""",
    "note_seeds": r"SELECT conv_id * 1000 + turn AS note_id, 'seed' AS role, regexp_replace(text, '^\s+|\s+$', '', 'g') AS text FROM conversations",
    "md_highlights": r"""SELECT conv_id, turn, 'md' AS fmt, 0::INT AS pos, trim(regexp_replace(text, '\s+', ' ', 'g')) AS quote, '' AS note FROM conversations WHERE trim(regexp_replace(text, '\s+', ' ', 'g')) <> ''""",
    "plain_topk": f"WITH {_PLAIN} SELECT seed_id, id, round(x, 6) AS similarity, pos::INT AS pos FROM plain WHERE pos <= 8",
    "pruned_topk": f"WITH {_PLAIN} SELECT seed_id, id, round(x, 6) AS similarity, pos::INT AS pos FROM plain WHERE pos <= 8",
    "corpus_rank": f"""WITH {_PLAIN}, r AS (SELECT seed_id, id, row_number() OVER (PARTITION BY seed_id ORDER BY x DESC, id) - 1 AS rank FROM sim)
        SELECT seed_id, id, pos::INT AS pos, rank, (SELECT count(*) FROM v) AS corpus_size FROM plain JOIN r USING (seed_id, id) WHERE pos <= 3""",
    "best_match_gate": f"WITH {_PLAIN} SELECT seed_id FROM plain WHERE pos = 1 AND x >= 0.35",
    "band_pool": f"WITH {_SIM}, {_BAND} SELECT seed_id, id, round(x, 6) AS similarity, pos::INT AS pos FROM band",
    "structural_gap": f"""WITH {_SIM}, {_STRUCT} SELECT seed_id, id, round(x, 6) AS similarity, round(y, 6) AS structural, pos::INT AS pos,
        CASE WHEN abs(y - x) < 1e-9 THEN 0.0 ELSE round(y - x, 6) END AS gap FROM structural""",
    "marks_best": f"WITH {_V}, {_MARKS} SELECT seed_id, id AS mark_id, id, round(x, 6) AS similarity, pos::INT AS pos FROM marked",
    "intra_list_div": f"""WITH {_PLAIN}, l AS (SELECT seed_id, id, pos FROM plain WHERE pos <= 8)
        SELECT a.seed_id, round(1 - avg(s.x), 6) AS ild FROM l a JOIN l b ON a.seed_id = b.seed_id AND a.id <> b.id
        JOIN sim s ON s.seed_id = a.id AND s.id = b.id GROUP BY a.seed_id""",
    "jaccard_matrix": f"""WITH {_PLAIN}, {_STRUCT}, {_MARKS}, e AS (
        SELECT seed_id, 'plain' AS engine, id FROM plain WHERE pos <= 8 UNION ALL SELECT seed_id, 'marks', id FROM marked UNION ALL SELECT seed_id, 'structural', id FROM structural
      ), s AS (SELECT seed_id, engine, list(id) AS ids FROM e GROUP BY ALL)
      SELECT a.seed_id, a.engine AS engine_a, b.engine AS engine_b, len(list_intersect(a.ids, b.ids))::INT AS shared,
        len(list_distinct(list_concat(a.ids, b.ids)))::INT AS total FROM s a JOIN s b ON a.seed_id = b.seed_id AND a.engine < b.engine""",
    "eval_engines": f"""WITH {_PLAIN}, {_BAND}, e AS (
        SELECT 'plain' AS engine, seed_id, book_id, seed_book FROM plain WHERE pos <= 8 UNION ALL SELECT 'band_pool', seed_id, book_id, seed_book FROM band WHERE pos <= 16
      ), per AS (SELECT engine, seed_id, count(*) AS k, count(DISTINCT book_id) AS books, sum((book_id <> seed_book)::INT) AS crossing FROM e GROUP BY ALL),
      s AS (SELECT v.id AS seed_id, engine FROM v, (SELECT DISTINCT engine FROM e))
      SELECT engine, round(avg(coalesce(k, 0)), 6) AS mean_k, round(avg((k IS NULL)::INT), 6) AS empty_rate, round(avg(books / k), 6) AS book_spread,
        round(sum(crossing) / sum(k), 6) AS cross_book_rate FROM s LEFT JOIN per USING (engine, seed_id) GROUP BY engine""",
    "chunkmap_nn": f"WITH {_PLAIN} SELECT seed_id, id AS nearest, round(x, 6) AS similarity, seed_book AS book_id FROM plain WHERE pos = 1",
    "distinctive_terms": f"WITH {_TOK} SELECT id, term, weight, pos::INT AS pos FROM dt",
    "lexical_theme": f"""WITH {_TOK}, {_THEME}, {_BM25} SELECT seed_id, id, pos::INT AS pos, score, n_terms FROM (
        SELECT *, row_number() OVER (PARTITION BY seed_id ORDER BY score DESC, id) AS pos FROM bm) WHERE pos <= 8""",
    "lexical_chunk": f"""WITH {_TOK}, q AS (SELECT id AS seed_id, term FROM dt), {_BM25}, {_CHUNK_TOP}
        SELECT seed_id, id, pos::INT AS pos, score, n_terms FROM lx WHERE pos <= 8""",
    "hybrid_rrf": f"""WITH {_PLAIN}, {_TOK}, q AS (SELECT id AS seed_id, term FROM dt WHERE id IN (SELECT id FROM v)), {_BM25}, {_ANY_TOP}, f AS (
        SELECT coalesce(a.seed_id, b.seed_id) AS seed_id, coalesce(a.id, b.id) AS id, a.pos AS dr, b.pos AS lr,
          coalesce(1.0::DOUBLE / (60 + a.pos), 0) + coalesce(1.0::DOUBLE / (60 + b.pos), 0) AS score
        FROM (SELECT seed_id, id, pos FROM plain) a FULL JOIN (SELECT seed_id, id, pos FROM lx) b ON a.seed_id = b.seed_id AND a.id = b.id)
      SELECT seed_id, id, pos::INT AS pos, CASE WHEN dr IS NULL THEN 'keyword only #' || lr WHEN lr IS NULL THEN 'dense only #' || dr
        ELSE 'dense #' || dr || ' + keyword #' || lr END AS why, round(score, 9) AS score FROM (
        SELECT *, row_number() OVER (PARTITION BY seed_id ORDER BY score DESC, coalesce(dr, 1000000000), coalesce(lr, 1000000000), id) AS pos FROM f) WHERE pos <= 8""",
    "concept_vocab": f"WITH {_CONCEPT} SELECT gram, mass FROM voc",
    "chunk_concepts": f"WITH {_CONCEPT} SELECT id, pos::INT AS pos, label FROM cc",
    "concept_graph_weights": f"""WITH {_CONCEPT}, l AS (
        SELECT id, label AS node, 1.0::DOUBLE AS w FROM cc
        UNION ALL SELECT doc_id, 'edge:' || source, 1.5 FROM labels JOIN documents USING (doc_id) WHERE quality = 1
      ), o AS (SELECT id, node, max(w) AS w FROM l GROUP BY ALL), c AS (SELECT node, count(*) AS n FROM o GROUP BY node)
      SELECT id, node, round(w / ln(2 + n), 6) AS w FROM o JOIN c USING (node)""",
    "cooccurrence_edges": f"""WITH {_CONCEPT}, pr AS (
        SELECT x.label AS a, y.label AS b, count(*) AS n FROM cc x JOIN cc y ON x.id = y.id AND x.label <> y.label GROUP BY ALL HAVING count(*) >= 2
      ), t AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY n DESC, b) AS r FROM pr)
      SELECT DISTINCT least(a, b) AS a, greatest(a, b) AS b, n FROM t WHERE r <= 4""",
    "edges_dedupe": """SELECT DISTINCT lang AS source, source AS target, doc_id AS provenance, 'authored' AS origin FROM labels JOIN documents USING (doc_id) WHERE quality = 1""",
    "books_index": """SELECT d.source AS book_id, count(DISTINCT d.doc_id) AS n_chunks, count(l.doc_id) AS n_marks FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY d.source""",
    "state_snapshot": """SELECT role, count(*) AS n, count(DISTINCT conv_id) AS conversations, sum(length(text))::BIGINT AS chars FROM conversations GROUP BY role""",
    "chat_msg_ids": """SELECT conv_id, turn, conv_id || ':' || (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) AS msg_id, role FROM conversations""",
    "usage_ledger": """SELECT ts::DATE AS day, count(*) AS requests, round(sum(value), 3) AS tokens FROM events GROUP BY 1""",
    "page_ingest_title": r"""WITH t AS (SELECT page_id, trim(regexp_replace(regexp_replace(regexp_extract(html, '(?s)<h1[^>]*>(.*?)</h1>', 1), '<[^>]+>', '', 'g'), '\s+', ' ', 'g')) AS title FROM pages)
        SELECT page_id, title, trim(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM t""",
    "eval_recall_mrr": f"""WITH {_TOK}, {_THEME}, {_BM25}, t AS (SELECT * FROM (
        SELECT *, row_number() OVER (PARTITION BY seed_id ORDER BY score DESC, id) AS pos FROM bm) WHERE pos <= 8), {_HELD},
      r AS (SELECT quote_id, min(pos) AS rank FROM h LEFT JOIN t ON t.seed_id = quote_id AND t.id = h.book_id GROUP BY quote_id)
      SELECT count(*) AS queries, round(avg(CASE WHEN rank <= 1 THEN 1.0 ELSE 0.0 END), 6) AS recall_1, round(avg(CASE WHEN rank <= 5 THEN 1.0 ELSE 0.0 END), 6) AS recall_5,
        round(avg(CASE WHEN rank <= 8 THEN 1.0 ELSE 0.0 END), 6) AS recall_8, round(avg(coalesce(1.0::DOUBLE / rank, 0)), 6) AS mrr FROM r""",
    "rhythm_features": f"""WITH {_EV} SELECT book, passage, round(attentive_ms, 6) AS attentive_ms, round(ms_per_word, 6) AS ms_per_word, revisits,
        round(first_pass_ms_per_word, 6) AS first_pass_ms_per_word, round(max_dwell_ms, 6) AS max_dwell_ms, selections, selected_not_highlighted FROM ft""",
    "rhythm_scores": f"""WITH {_EV}, {_SC} SELECT book, passage, round(attentive_ms, 6) AS attentive_ms, revisits, selections, z, hotspot FROM sc""",
    "rhythm_baseline": f"""WITH {_EV}, {_BASE} SELECT book, round(med, 6) AS med, round(spread, 6) AS spread, n, have_baseline FROM base""",
    "rhythm_candidates": f"""WITH {_LOG}, dz AS (SELECT * REPLACE (passage % 12 AS passage) FROM ev), {_rhythm('book', 'dz', '')}, {_BASE},
      last AS (SELECT book, max(session) AS session FROM dz GROUP BY book), own AS (SELECT dz.* FROM dz JOIN last USING (book, session)),
      {_rhythm('book, session', 'own', '_own')}, {_scored('ft_own', 'so')}
      SELECT book, session, passage, row_number() OVER (PARTITION BY book ORDER BY z DESC, passage)::INT AS pos, z,
        concat_ws(',', CASE WHEN z >= 1.0 AND attentive_ms >= 1500 THEN 'slow' END, CASE WHEN revisits > 0 THEN 'revisited' END, CASE WHEN selected_not_highlighted THEN 'selected' END) AS signals,
        revisits, round(attentive_ms, 6) AS attentive_ms, have_baseline FROM so WHERE hotspot AND passage NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)""",
    "rhythm_stream": f"""WITH {_LOG}, mk AS (SELECT *, lead(t) OVER (PARTITION BY book, session ORDER BY t, event_id) AS u FROM ev WHERE type IN ('enter', 'exit')),
      sp AS (SELECT *, lag(type) OVER (PARTITION BY book, session ORDER BY t, event_id) AS before, min(CASE WHEN type = 'active' THEN {{'t': t, 'e': event_id}} END)
        OVER (PARTITION BY book, session ORDER BY t, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS u FROM ev WHERE type IN ('idle', 'active'))
      SELECT 'visit' AS kind, book, session::VARCHAR AS session, passage, t AS start, coalesce(u, t) AS "end", event_id, u IS NULL AS open FROM mk WHERE type = 'enter'
      UNION ALL SELECT 'idle', book, session::VARCHAR, NULL, t, u.t, u.e, false FROM sp WHERE type = 'idle' AND before IS DISTINCT FROM 'idle' AND u IS NOT NULL""",
    "heat_portrait": f"""WITH {_EV} SELECT book, passage, round(least(1.0, attentive_ms / greatest(1.0, max(attentive_ms) OVER (PARTITION BY book))), 6) AS heat FROM ft""",
    "chunk_blocks": r"""WITH b AS (SELECT doc_id AS book_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents),
      t AS (SELECT book_id, pos, regexp_replace(raw, '^\s+|\s+$', '', 'g') AS x FROM b)
      SELECT book_id, pos::INT AS pos, CASE WHEN regexp_full_match(x, '<!--\s*page\s+\d+\s*-->') AND length(x) < 40 THEN 'page' WHEN regexp_full_match(x, '#{1,6} .*') THEN 'heading' ELSE 'para' END AS kind,
        len(regexp_extract_all(x, '\S+'))::INT AS words FROM t WHERE x <> ''""",
    "word_counts": rf"""WITH {_TOK}, w AS (SELECT doc_id, text, regexp_extract_all(text, '\S+') AS w FROM documents)
        SELECT doc_id, len(w)::INT AS words, len(t)::INT AS tokens, len(list_distinct(regexp_extract_all(lower(text), '[a-z]{{3,}}')))::INT AS bag, round({_PROSE}, 6) AS prose
        FROM w JOIN tok ON id = doc_id""",
    "boilerplate_filter": rf"""WITH w AS (SELECT doc_id, text, lower(text) AS low, regexp_extract_all(text, '\S+') AS w FROM documents), x AS (
        SELECT doc_id, text, low, {_HITS} AS hits, {_PROSE} AS prose FROM w)
      SELECT doc_id FROM x WHERE (contains(low, 'intentionally omitted') AND length(text) < 600) OR hits >= 2 OR (hits >= 1 AND prose < 0.65) OR prose < 0.5""",
    "neighbours": """SELECT doc_id AS id, lag(doc_id) OVER w AS prev_id, lead(doc_id) OVER w AS next_id, substr(lag(text) OVER w, 1, 240) AS prev_text,
        substr(lead(text) OVER w, 1, 240) AS next_text FROM documents WINDOW w AS (PARTITION BY source ORDER BY doc_id)""",
    "sections_greedy": f"""WITH RECURSIVE {_SECTIONS}
      SELECT book_id, section::INT AS section, count(*) AS n_units, min(id) AS first_id, max(id) AS last_id, sum(words)::BIGINT AS words FROM r GROUP BY ALL""",
    "toc": """WITH m AS (
        SELECT source AS book_id, doc_id AS id, CASE WHEN trim(lang) <> '' THEN trim(lang) END AS title, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS place FROM documents
      ), t AS (
        SELECT *, title IS NOT NULL AND title IS DISTINCT FROM last_value(title IGNORE NULLS) OVER (PARTITION BY book_id ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS turn,
          count(title) OVER (PARTITION BY book_id) AS titled FROM m
      ), c AS (SELECT *, sum(turn::INT) OVER (PARTITION BY book_id) AS turns, sum(turn::INT) OVER (PARTITION BY book_id ORDER BY id) AS k FROM t)
      SELECT book_id, id, title FROM c WHERE titled >= 3 AND turn AND (k - 1) % (CASE WHEN turns > 300 THEN greatest(1, turns // 120) ELSE 1 END) = 0
      UNION ALL SELECT book_id, id, 'Passage ' || (place + 1) FROM c WHERE titled < 3 AND place % 25 = 0""",
    "map_2d": f"WITH {_V}, {_placed('v')} SELECT id, round(x, 6) AS x, round(y, 6) AS y FROM placed",
    "chunk_map_nodes": f"WITH {_V}, {_LEVELS}, {_placed('un')} SELECT level, id, book_id, square.x, square.y FROM un JOIN square USING (id)",
    "chunk_map_edges": f"""WITH {_V}, {_LEVELS} SELECT id AS source, parent_id AS target, 'parent' AS kind FROM un WHERE parent_id IN (SELECT id FROM un)
      UNION ALL SELECT source, target, 'near' FROM (SELECT a.id AS source, b.id AS target, row_number() OVER (PARTITION BY a.id ORDER BY list_dot_product(a.e, b.e) DESC, b.id) AS r FROM un a JOIN un b ON a.level = b.level AND a.id <> b.id) WHERE r = 1""",
    "concept_map": f"""WITH {_CONCEPT}, lb AS (SELECT label, row_number() OVER (ORDER BY label) AS k FROM (SELECT DISTINCT label FROM cc)),
      co AS (SELECT a.k AS i, b.k AS j, count(*) AS n FROM (SELECT cc.id, k FROM cc JOIN lb USING (label)) a JOIN (SELECT cc.id, k FROM cc JOIN lb USING (label)) b ON a.id = b.id AND a.k <> b.k GROUP BY ALL),
      pt AS (SELECT a.k AS id, list(coalesce(n, 0)::DOUBLE ORDER BY b.k) AS e FROM lb a CROSS JOIN lb b LEFT JOIN co ON co.i = a.k AND co.j = b.k GROUP BY a.k), {_placed('pt')},
      bo AS (SELECT label, source AS book, count(*) AS own FROM cc JOIN documents ON doc_id = cc.id GROUP BY ALL)
      SELECT label, n, book, square.x, square.y FROM lb JOIN square ON square.id = lb.k JOIN (SELECT label, sum(own)::BIGINT AS n, arg_min(book, (-own, book)) AS book FROM bo GROUP BY label) USING (label)""",
    "chunk_accumulate": f"""WITH RECURSIVE {_SMALL} SELECT book_id, n::INT AS n, words::INT AS words, start, stop AS "end" FROM pa""",
    "parents_link": f"""WITH RECURSIVE {_SMALL}, {_accumulated('_p', 500, 60)},
      c AS (SELECT book_id, printf('%d#%04d', book_id, n) AS id, list_distinct(regexp_extract_all(lower(body), '[a-z]{{3,}}')) AS w FROM pa),
      p AS (SELECT book_id, n, printf('%d#P%04d', book_id, n) AS parent_id, list_distinct(regexp_extract_all(lower(body), '[a-z]{{3,}}')) AS pw FROM pa_p)
      SELECT id, parent_id, round(overlap, 6) AS overlap FROM (
        SELECT id, parent_id, len(list_intersect(w, pw)) / len(w) AS overlap, row_number() OVER (PARTITION BY id ORDER BY len(list_intersect(w, pw)) / len(w) DESC, n) AS r FROM c JOIN p USING (book_id) WHERE len(w) > 0
      ) WHERE r = 1 AND overlap > 0""",
    "propositions": rf"""WITH RECURSIVE {_SMALL}, s AS (
        SELECT book_id, n AS unit, printf('%d#%04d', book_id, n) AS id, unnest(string_split(regexp_replace(body, '([.!?])\s+([A-Z"''(])', '\1' || chr(1) || '\2', 'g'), chr(1))) AS x,
          generate_subscripts(string_split(regexp_replace(body, '([.!?])\s+([A-Z"''(])', '\1' || chr(1) || '\2', 'g'), chr(1)), 1) AS pos FROM pa)
      SELECT book_id, id, (row_number() OVER (PARTITION BY book_id ORDER BY unit, id, pos) - 1)::INT AS n, length(x)::INT AS n_chars FROM s WHERE len(regexp_extract_all(x, '\S+')) >= 5""",
    "anchor_chunks_for": f"""WITH RECURSIVE {_SMALL}, {_HELD}, sp AS (SELECT concat_ws(':', quote_id, book_id) AS span_id, book_id, instr(text, quote) - 1 AS a, instr(text, quote) - 1 + length(quote) AS b FROM h),
      o AS (SELECT span_id, printf('%d#%04d', book_id, n) AS id, (least(b, stop) - greatest(a, start))::BIGINT AS overlap FROM sp JOIN pa USING (book_id) WHERE a < stop AND start < b)
      SELECT span_id, id, overlap, (row_number() OVER (PARTITION BY span_id ORDER BY overlap DESC, id))::INT AS pos FROM o""",
    "semantic_cuts": f"""WITH {_V}, l AS (SELECT id, e, lag(e) OVER (PARTITION BY book_id ORDER BY id) AS f FROM v)
        SELECT id, round(list_dot_product(e, f), 6) AS cosine, list_dot_product(e, f) < 0.55 AS cut FROM l WHERE f IS NOT NULL""",
    "lenient_replies": """SELECT conv_id, turn, (conv_id + turn) % 6 AS kind, CASE WHEN (conv_id + turn) % 6 < 5 THEN conv_id END AS id,
      CASE WHEN (conv_id + turn) % 6 < 5 THEN md5(text) END AS said, CASE WHEN (conv_id + turn) % 6 < 5 THEN turn END AS inner FROM conversations WHERE text IS NOT NULL""".replace("AS inner", 'AS "inner"'),
    "marks_versioned": """WITH m AS (SELECT doc_id AS mark_id, source AS book_id, quality, lang AS note FROM labels JOIN documents USING (doc_id)),
      u AS (SELECT mark_id, CASE WHEN mark_id % 5 <> 0 AND mark_id % 7 = 0 THEN 'moved' ELSE book_id END AS book_id, CASE WHEN mark_id % 5 = 0 THEN NULL ELSE quality END AS quality, CASE WHEN mark_id % 5 = 0 THEN 'x' ELSE note END AS note FROM m)
      SELECT * FROM u WHERE mark_id % 11 <> 0 AND book_id <> 'src1' UNION ALL SELECT * FROM m WHERE book_id = 'src1' AND quality = 1""",
    "uploads_named": r"""WITH a AS (SELECT page_id AS upload_id, CASE WHEN page_id % 9 = 0 THEN 'Big Book (2).PDF' WHEN page_id % 9 = 1 THEN '???.epub' ELSE 'in/Übung ' || page_id % 4 || '.v1.pdf' END AS filename,
        CASE WHEN page_id % 9 = 0 THEN 'big-book-2' WHEN page_id % 9 = 1 THEN 'book' ELSE 'bung-' || page_id % 4 || '-v1' END AS slug FROM pages),
      r AS (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY upload_id) AS rank FROM a),
      e AS (SELECT DISTINCT CASE WHEN doc_id % 3 = 0 THEN doc_id ELSE 1 END AS number, 'big-book-2' AS slug FROM documents WHERE doc_id > 0 UNION SELECT 1, 'bung-3-v1' UNION SELECT 2, 'bung-3-v1' UNION SELECT 2, 'book'),
      f AS (SELECT slug, number, row_number() OVER (PARTITION BY slug ORDER BY number) AS rank FROM (SELECT slug, number FROM (SELECT DISTINCT slug FROM a), range(1, 20000) g(number)) ANTI JOIN e USING (slug, number))
      SELECT upload_id, filename, CASE WHEN number = 1 THEN slug ELSE slug || '-' || number END AS book_id FROM r JOIN f USING (slug, rank)""",
    "detect_book": f"WITH {_HELD} SELECT quote_id, book_id, ((length(text) - length(replace(text, quote, ''))) // length(quote))::BIGINT AS hits FROM h",
    "anchor_typos": rf"""WITH {_HELD}, o AS (SELECT *, instr(text, quote) AS place, (length(text) - length(replace(text, quote, ''))) // length(quote) = 1 AS sure FROM h)
      SELECT quote_id * 1000000000 + book_id AS quote_id, CASE WHEN sure THEN (place - 1 - length(regexp_extract(substr(text, 1, place - 1), '\S*$')))::BIGINT END AS start,
        CASE WHEN sure THEN (place - 1 + length(quote) + length(regexp_extract(substr(text, place + length(quote)), '^\S*')))::BIGINT END AS "end",
        CASE WHEN sure THEN 'fuzzy' ELSE 'orphan' END AS tier FROM o""",
    "anchor_exact": f"WITH {_HELD} SELECT quote_id, book_id, (instr(text, quote) - 1)::BIGINT AS start, length(quote)::BIGINT AS n_chars FROM h",
    "orphan_candidates": r"""WITH q AS (SELECT item_id AS quote_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]{3,}')) AS w FROM benchmark),
      c AS (SELECT doc_id AS id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]{3,}')) AS w FROM documents),
      s AS (SELECT quote_id, id, len(q.w) AS n, len(list_intersect(q.w, c.w)) AS hits FROM q, c)
      SELECT quote_id, id, round(hits / n, 6) AS overlap, pos::INT AS pos FROM (
        SELECT *, row_number() OVER (PARTITION BY quote_id ORDER BY hits DESC, id) AS pos FROM s WHERE hits > 0) WHERE pos <= 5""",
    "enrich_pending": f"WITH {_KNOWN} SELECT DISTINCT h AS hash, length(text)::INT AS n_chars FROM hashed WHERE text IS NOT NULL AND h NOT IN (SELECT h FROM known)",
    "enrich_cached": f"WITH {_KNOWN} SELECT doc_id AS id, CASE WHEN h IN (SELECT h FROM known) THEN 'cached' ELSE length(text)::VARCHAR END AS value FROM hashed",
    "verdicts_kept": f"""WITH {_PLAIN}, t AS (
        SELECT seed_id, p.id, pos, length(b.text) AS n, length(a.text) + length(b.text) AS both_n FROM plain p JOIN documents a ON a.doc_id = seed_id JOIN documents b ON b.doc_id = p.id WHERE pos <= 8)
      SELECT seed_id, id, row_number() OVER (PARTITION BY seed_id ORDER BY n % 7 DESC, pos)::INT AS pos, 'low' AS forced_risk, n % 7 / 8 AS confidence FROM t WHERE n % 4 <> 0 AND both_n % 5 <> 0""",
    "rag_context": f"""WITH {_PLAIN}, c AS (
        SELECT seed_id, string_agg('[' || pos || '] ' || source || chr(10) || substr(text, 1, 800), chr(10) || chr(10) ORDER BY pos) AS context FROM plain JOIN documents ON doc_id = id WHERE pos <= 6 GROUP BY seed_id)
      SELECT seed_id, length(context)::INT AS n_chars, md5(context) AS digest FROM c""",
    "mark_colours": f"SELECT vec_id, list_min([{_COLOURS}]).name AS colour FROM (SELECT vec_id, embedding[1]::DOUBLE + 0.5 AS r, embedding[2]::DOUBLE + 0.5 AS g, embedding[3]::DOUBLE + 0.5 AS b FROM embeddings)",
    "pinned_orphans": r"""WITH q AS (SELECT item_id, text AS quote, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]{3,}')) AS w FROM benchmark),
      c AS (SELECT doc_id, text, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]{3,}')) AS w FROM documents),
      s AS (SELECT item_id, quote, doc_id, text, row_number() OVER (PARTITION BY item_id ORDER BY len(list_intersect(q.w, c.w)) DESC, doc_id) AS pos, len(list_intersect(q.w, c.w)) AS hits FROM q, c),
      p AS (SELECT *, instr(text, quote) AS place FROM s WHERE pos = 1 AND hits > 0)
      SELECT item_id AS mark_id, doc_id AS id, greatest(place - 1, 0)::BIGINT AS start, (CASE WHEN place > 0 THEN place - 1 + length(quote) ELSE length(text) END)::BIGINT AS "end", place = 0 AS approximate FROM p""",
    "catalog_titles": "SELECT DISTINCT upper(source[1]) || source[2:] || coalesce(' ' || upper(lang[1]) || lang[2:], '') AS title FROM documents",
    "edges_digest": """SELECT 'authored' AS origin, count(*) AS n, count(DISTINCT lang) AS n_sources, count(DISTINCT source) AS n_targets
        FROM labels JOIN documents USING (doc_id) WHERE quality = 1 HAVING count(*) > 0""",
    "sample_systematic": """WITH n AS (SELECT *, row_number() OVER (ORDER BY doc_id) - 1 AS place, greatest(1, count(*) OVER () // 40) AS step FROM documents)
        SELECT doc_id, lang FROM n WHERE place % step = 0 AND place < 40 * step""",
    "readiness_report": f"""WITH {_V}, {_MARKS}, {_CONCEPT}, n AS (
        SELECT (SELECT count(*) FROM v) > 0 AS v, (SELECT count(*) FROM documents) > 0 AS c, (SELECT count(*) FROM cc) > 0 AS k,
          (SELECT count(*) FROM m WHERE NOT orphaned AND quote <> '') > 0 AS m)
      SELECT engine, ready, CASE WHEN NOT ready THEN why END AS reason FROM (
        SELECT unnest(['band', 'spread', 'plain', 'echo', 'walk']) AS engine, v AS ready, 'no vectors' AS why FROM n
        UNION ALL SELECT 'lexical', c, 'no passages' FROM n UNION ALL SELECT 'hybrid', v AND c, 'no vectors or no passages' FROM n
        UNION ALL SELECT 'concept', k, 'concepts missing or out of date' FROM n UNION ALL SELECT 'marks', m, 'no mark on a passage' FROM n
        UNION ALL SELECT 'structural', v, 'second vectors missing for some passages' FROM n)""",
    "eval_report": f"""WITH {_PLAIN}, {_STRUCT}, {_MARKS}, e AS (
        SELECT 'plain' AS engine, seed_id, id, book_id, seed_book FROM plain WHERE pos <= 8 UNION ALL SELECT 'structural', seed_id, id, book_id, seed_book FROM structural
      ), rk AS (SELECT seed_id, id, row_number() OVER (PARTITION BY seed_id ORDER BY x DESC, id) - 1 AS rank FROM sim
      ), per AS (SELECT engine, seed_id, count(*) AS k, count(DISTINCT book_id) AS books, sum((book_id <> seed_book)::INT) AS crossing FROM e GROUP BY ALL
      ), f AS (SELECT engine, avg(coalesce(k, 0)) AS mean_k, avg((k IS NULL)::INT) AS empty_rate, avg(books / k) AS book_spread, sum(crossing) / sum(k) AS cross_book_rate
        FROM (SELECT v.id AS seed_id, engine FROM v, (SELECT DISTINCT engine FROM e)) LEFT JOIN per USING (engine, seed_id) GROUP BY engine
      ), g AS (SELECT engine, avg(100 * rank / (SELECT count(*) FROM v)) AS mean_rank_pct, floor(quantile_cont(rank, 0.5))::BIGINT AS median_rank FROM e JOIN rk USING (seed_id, id) GROUP BY engine
      ), i AS (SELECT engine, avg(ild) AS ild FROM (
        SELECT a.engine, a.seed_id, 1 - avg(s.x) AS ild FROM e a JOIN e b ON a.engine = b.engine AND a.seed_id = b.seed_id AND a.id <> b.id JOIN sim s ON s.seed_id = a.id AND s.id = b.id GROUP BY ALL) GROUP BY engine
      ), b AS (SELECT target AS seed_id, target + 1 AS id FROM m WHERE NOT orphaned
      ), h AS (SELECT n.engine, avg((e.id IS NOT NULL)::INT) AS bridge_recall FROM b CROSS JOIN (SELECT DISTINCT engine FROM e) n LEFT JOIN e ON e.engine = n.engine AND e.seed_id = b.seed_id AND e.id = b.id GROUP BY n.engine
      ), z AS (SELECT 'plain' AS engine, avg((x >= 0.35)::INT) AS noise_fp_rate FROM plain WHERE pos = 1)
      SELECT engine, round(mean_k, 6) AS mean_k, round(empty_rate, 6) AS empty_rate, round(book_spread, 6) AS book_spread, round(cross_book_rate, 6) AS cross_book_rate,
        round(mean_rank_pct, 6) AS mean_rank_pct, median_rank, round(ild, 6) AS ild, round(noise_fp_rate, 6) AS noise_fp_rate, round(bridge_recall, 6) AS bridge_recall
      FROM f LEFT JOIN g USING (engine) LEFT JOIN i USING (engine) LEFT JOIN h USING (engine) LEFT JOIN z USING (engine)""",
    "compare_models": f"""WITH {_SIM}, a AS (
        SELECT seed_id, list(id) AS a FROM (SELECT seed_id, id, row_number() OVER (PARTITION BY seed_id ORDER BY x DESC, id) AS pos FROM sim WHERE id <> seed_id) WHERE pos <= 8 GROUP BY seed_id
      ), b AS (SELECT seed_id, list(id) AS b FROM (SELECT seed_id, id, row_number() OVER (PARTITION BY seed_id ORDER BY y DESC, id) AS pos FROM sim WHERE id <> seed_id) WHERE pos <= 8 GROUP BY seed_id
      ), c AS (SELECT seed_id, len(list_intersect(a, b)) AS shared, len(list_distinct(list_concat(a, b))) AS total FROM a JOIN b USING (seed_id))
      SELECT seed_id, shared::INT AS shared, total::INT AS total, round(shared / total, 4) AS jaccard FROM c""",
    "embed_leaderboard": rf"""WITH {_TOK}, {_THEME}, {_BM25}, {_HELD}, gold AS (SELECT quote_id AS seed_id, book_id AS id FROM h),
      qw AS (SELECT item_id AS seed_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]{{3,}}')) AS w FROM benchmark),
      cw AS (SELECT doc_id AS id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]{{3,}}')) AS w FROM documents),
      hits AS (SELECT seed_id, id, len(list_intersect(qw.w, cw.w)) AS hits FROM qw, cw),
      found AS (
        SELECT 'bm25' AS model, seed_id, id, row_number() OVER (PARTITION BY seed_id ORDER BY score DESC, id) AS pos FROM bm
        UNION ALL SELECT 'shared_words', seed_id, id, row_number() OVER (PARTITION BY seed_id ORDER BY hits DESC, id) FROM hits WHERE hits > 0),
      best AS (SELECT model, seed_id, min(pos) AS rank FROM gold CROSS JOIN (SELECT unnest(['bm25', 'shared_words']) AS model)
        LEFT JOIN (SELECT * FROM found WHERE pos <= 10) USING (model, seed_id, id) GROUP BY ALL),
      s AS (SELECT model, count(*) AS queries, avg(CASE WHEN rank <= 1 THEN 1.0 ELSE 0.0 END) AS recall_1, avg(CASE WHEN rank <= 3 THEN 1.0 ELSE 0.0 END) AS recall_3,
        avg(CASE WHEN rank <= 5 THEN 1.0 ELSE 0.0 END) AS recall_5, avg(CASE WHEN rank <= 10 THEN 1.0 ELSE 0.0 END) AS recall_10, avg(coalesce(1.0::DOUBLE / rank, 0)) AS mrr,
        avg(rank) AS mean_rank, floor(quantile_cont(rank, 0.5))::BIGINT AS median_rank FROM best GROUP BY model)
      SELECT model, queries, round(recall_1, 6) AS recall_1, round(recall_3, 6) AS recall_3, round(recall_5, 6) AS recall_5, round(recall_10, 6) AS recall_10, round(mrr, 6) AS mrr,
        round(mean_rank, 6) AS mean_rank, median_rank, row_number() OVER (ORDER BY recall_5 DESC, mrr DESC, model)::INT AS place FROM s""",
    "usage_budget": """WITH l AS (SELECT ts::DATE AS day, count(*) AS requests, round(sum(value), 3) AS tokens FROM events GROUP BY 1),
      b AS (SELECT *, greatest(0, least(10, floor(tokens / 25000.0::DOUBLE * 10 + 0.5)))::INT AS filled FROM l)
      SELECT day, requests, tokens, round(100 * (tokens / 25000.0::DOUBLE), 1) AS percent, repeat('#', filled) || repeat('.', 10 - filled) AS bar FROM b""",
    "log_summary": """WITH e AS (SELECT user_id AS book, ts::DATE AS session,
        CASE event_type WHEN 'view' THEN 'enter' WHEN 'purchase' THEN 'exit' WHEN 'click' THEN 'select' WHEN 'error' THEN 'idle' WHEN 'signup' THEN 'active' END AS type FROM events),
      t AS (SELECT book, type, count(*) AS n FROM e WHERE type IS NOT NULL GROUP BY ALL), l AS (SELECT book, string_agg(type || '=' || n, ',' ORDER BY type) AS by_type FROM t GROUP BY book)
      SELECT book, total, sessions, by_type FROM (SELECT book, count(*) AS total, count(DISTINCT session) AS sessions FROM e GROUP BY book) LEFT JOIN l USING (book)""",
    "dwell_portrait": f"""WITH {_EV}, {_SC}, p AS (SELECT lang AS character, count(*) AS n, avg(z) AS z FROM sc JOIN documents ON doc_id = passage WHERE attentive_ms >= 1500 GROUP BY lang)
      SELECT character, n, round(z, 6) AS z, CASE WHEN z > 0.3 THEN 'slow' WHEN z < -0.3 THEN 'skim' ELSE 'even' END AS pace FROM p WHERE n >= 2""",
    "concept_counts": f"WITH {_CONCEPT} SELECT label, count(*) AS n, count(DISTINCT source) AS n_books FROM cc JOIN documents ON doc_id = id GROUP BY label",
    "concept_sites": f"""WITH {_CONCEPT}, s AS (SELECT label, id, row_number() OVER (PARTITION BY label ORDER BY id) AS place FROM cc)
      SELECT label, place::INT AS pos, id, substr(text, 1, 240) AS preview FROM s JOIN documents ON doc_id = id WHERE place <= 40""",
    "section_texts": f"""WITH RECURSIVE {_SECTIONS}, j AS (
        SELECT r.book_id, section, string_agg(text, chr(10) || chr(10) ORDER BY id) AS t FROM r JOIN documents ON doc_id = id GROUP BY ALL)
      SELECT book_id, section::INT AS section, length(t)::INT AS n_chars, md5(t) AS digest FROM j""",
    "semantic_passages": rf"""WITH RECURSIVE {_V}, u AS (
        SELECT id, v.book_id, len(regexp_extract_all(text, '\S+')) AS words, list_dot_product(e, lag(e) OVER w) AS cosine, row_number() OVER w AS k
        FROM v JOIN documents ON doc_id = id WINDOW w AS (PARTITION BY v.book_id ORDER BY id)
      ), r AS (
        SELECT book_id, k, id, words, 0 AS section, words AS held FROM u WHERE k = 1
        UNION ALL SELECT u.book_id, u.k, u.id, u.words, r.section + (r.held >= 240 OR (r.held >= 60 AND u.cosine < 0.55))::INT,
          CASE WHEN r.held >= 240 OR (r.held >= 60 AND u.cosine < 0.55) THEN u.words ELSE r.held + u.words END
        FROM r JOIN u ON u.book_id = r.book_id AND u.k = r.k + 1)
      SELECT book_id, section::INT AS section, count(*) AS n_units, min(id) AS first_id, max(id) AS last_id, sum(words)::BIGINT AS words FROM r GROUP BY ALL""",
    "highlight_runs": f"""WITH {_HELD}, ln AS (
        SELECT doc_id AS book_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents
      ), rn AS (SELECT book_id, s AS f, s + length(x) AS t FROM (
        SELECT book_id, x, coalesce(sum(length(x) + 1) OVER (PARTITION BY book_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS s FROM ln) WHERE length(x) > 0
      ), sp AS (SELECT quote_id AS span_id, book_id, instr(text, quote) - 1 AS a, instr(text, quote) - 1 + length(quote) AS b FROM h
      ), c AS (
        SELECT book_id, f, t, f AS place FROM rn UNION SELECT book_id, f, t, t FROM rn
        UNION SELECT rn.book_id, f, t, greatest(a, f) FROM rn JOIN sp ON rn.book_id = sp.book_id AND a < t AND b > f
        UNION SELECT rn.book_id, f, t, least(b, t) FROM rn JOIN sp ON rn.book_id = sp.book_id AND a < t AND b > f
      ), p AS (SELECT book_id, place AS x, lead(place) OVER (PARTITION BY book_id, f, t ORDER BY place) AS y FROM c)
      SELECT p.book_id, x::BIGINT AS start, y::BIGINT AS "end", min(span_id) AS span_id FROM p LEFT JOIN sp ON sp.book_id = p.book_id AND a <= x AND b >= y WHERE y IS NOT NULL GROUP BY ALL""",
    "session_list": f"""WITH s AS (SELECT conv_id, arg_min(text, turn) FILTER (role = 'user') AS x, count(*) AS n, arg_max(role, turn) AS last_role FROM conversations GROUP BY conv_id)
      SELECT conv_id AS target, {_CLIP("x", 80)} AS title, n, last_role FROM s""",
    "doc_summaries": f"""WITH s AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: length(x) > 30)[1] AS x FROM documents)
      SELECT doc_id, {_CLIP("x", 280)} AS summary FROM s""",
    "labels_merged": "SELECT doc_id, CASE WHEN toxic = 1 THEN 0 ELSE quality END AS quality, toxic FROM labels",
}

_RANK = "rk AS (SELECT seed_id, id, x, row_number() OVER (PARTITION BY seed_id ORDER BY x DESC, id) - 1 AS rank FROM sim)"


def _contract(key: str, rows: str, why: str, score: str, places: int = 4) -> str:
    """The contract's columns over `rows` (seed_id, id, pos and more)."""
    return f"""SELECT t.seed_id, t.id, t.pos::INT AS pos, round(rk.x, 4) AS similarity, rk.rank, (SELECT count(*) FROM v) AS corpus_size, round({score}, {places}) AS score,
        '{key}' AS path, {why} AS why FROM {rows} t LEFT JOIN rk ON rk.seed_id = t.seed_id AND rk.id = t.id"""


_HASHED = """w AS (SELECT id, unnest(regexp_extract_all(lower(text), '\\S+')) AS w FROM src),
  h AS (SELECT id, ('0x' || substr(md5(w), 1, 8))::BIGINT % 64 AS k, CASE WHEN ('0x' || substr(md5(w), 9, 1))::BIGINT % 2 = 1 THEN 1 ELSE -1 END AS s FROM w),
  x AS (SELECT id, k, sum(s)::DOUBLE AS x FROM h GROUP BY ALL), l AS (SELECT id, sqrt(sum(x * x)) AS l FROM x GROUP BY id)
  SELECT src.id, round(coalesce(sum(k * x / CASE WHEN l = 0 THEN 1 ELSE l END), 0), 6) AS moment, coalesce(sum((x <> 0)::INT), 0)::BIGINT AS n FROM src LEFT JOIN x USING (id) LEFT JOIN l USING (id) GROUP BY src.id"""
_IMPORTED = f"""{_HELD}, bk AS (SELECT doc_id AS book_id, text FROM documents), im AS (
  SELECT quote_id AS item, book_id, quote FROM h UNION SELECT item_id, item_id, text FROM benchmark
), an AS (
  SELECT item * 1000000 + book_id AS quote_id, item, book_id, quote, text, coalesce((length(text) - length(replace(text, quote, ''))) / length(quote), 0) AS times FROM im LEFT JOIN bk USING (book_id))"""

ORACLE_SQL |= {
    "connect_plain": f"WITH {_PLAIN}, {_RANK} " + _contract("plain", "(SELECT * FROM plain WHERE pos <= 8)", "'#' || (rank + 1) || ' nearest by surface similarity'", "rk.x"),
    "connect_band": f"WITH RECURSIVE {_BAND_V}, {_mmr('bd', 0.4)}, {_RANK} "
    + _contract("band", "(SELECT *, step AS pos FROM mmr)", "'in the resonance band — #' || (rank + 1) || ' of ' || (SELECT count(*) FROM v) || ' by similarity, past the obvious top matches, from another book'", "rk.x"),
    "connect_spread": f"WITH RECURSIVE {_BAND_V}, {_DPP}, {_COVERS}, {_RANK}, sp AS (SELECT pk.*, step AS pos, coalesce(covers, 0) AS covers, (SELECT count(*) FROM bd WHERE bd.seed_id = pk.seed_id) AS n FROM pk LEFT JOIN cv USING (seed_id, id)) "
    + _contract("spread", "sp", "'set-spread pick ' || t.pos || ' — covers ' || covers || ' of ' || n || ' band passages, sim ' || printf('%.2f', rk.x) || ', #' || (rank + 1) || ' of ' || (SELECT count(*) FROM v) || ' by similarity'", "t.score"),
    "connect_echo": f"WITH RECURSIVE {_SIM}, {_ECHO}, {_mmr('ec', 0.6)}, {_RANK} "
    + _contract("echo", "(SELECT mmr.*, step AS pos, distance FROM mmr JOIN ec USING (seed_id, id))", "'same book, ' || distance || ' passages away — sim ' || printf('%.2f', rk.x)", "rk.x"),
    "connect_walk": f"WITH RECURSIVE {_SIM}, {_WALK}, {_RANK} "
    + _contract("walk", "(SELECT *, hop AS pos FROM wk WHERE hop > 0)", "'hop ' || hop || ' from ' || from_id || ' — sim ' || printf('%.2f', h) || ' to the previous step'", "h"),
    "connect_structural": f"WITH {_SIM}, {_STRUCT}, {_RANK} " + _contract("structural", "structural", "'same move (' || printf('%.2f', y) || ' structural vs ' || printf('%.2f', rk.x) || ' surface)'", "y"),
    "connect_marks": f"WITH {_SIM}, {_MARKS}, {_RANK} "
    + _contract("marks", "(SELECT marked.*, trim(quote) AS q FROM marked JOIN m ON m.target = marked.id)", f"'your highlight — “' || {_CLIP('q', 80)} || '”'", "t.x"),
    "connect_lexical": f"""WITH {_SIM}, {_TOK}, q AS (SELECT id AS seed_id, term FROM dt WHERE id IN (SELECT id FROM v)), bm AS (
        SELECT q.seed_id, p.id, round(sum(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score, list_sort(list(term)) AS terms
        FROM q JOIN idf USING (term) JOIN p USING (term) GROUP BY ALL HAVING score > 0), {_RANK}, lx AS (
        SELECT *, row_number() OVER (PARTITION BY seed_id ORDER BY score DESC, id) AS pos FROM bm WHERE seed_id <> id) """
    + _contract("lexical", "(SELECT * FROM lx WHERE pos <= 8)", "'keyword match: ' || array_to_string(terms[1:6], ', ') || CASE WHEN len(terms) > 6 THEN ' (+' || (len(terms) - 6) || ' more)' ELSE '' END", "t.score", 6),
    "connect_hybrid": f"""WITH {_PLAIN}, {_TOK}, q AS (SELECT id AS seed_id, term FROM dt WHERE id IN (SELECT id FROM v)), {_BM25}, {_ANY_TOP}, f AS (
        SELECT coalesce(a.seed_id, b.seed_id) AS seed_id, coalesce(a.id, b.id) AS id, a.pos AS dr, b.pos AS lr, coalesce(1.0::DOUBLE / (60 + a.pos), 0) + coalesce(1.0::DOUBLE / (60 + b.pos), 0) AS score
        FROM (SELECT seed_id, id, pos FROM plain) a FULL JOIN (SELECT seed_id, id, pos FROM lx) b ON a.seed_id = b.seed_id AND a.id = b.id
      ), g AS (SELECT *, row_number() OVER (PARTITION BY seed_id ORDER BY score DESC, coalesce(dr, 1000000000), coalesce(lr, 1000000000), id) AS pos FROM f), {_RANK} """
    + _contract("hybrid", "(SELECT * FROM g WHERE pos <= 8)", "CASE WHEN dr IS NULL THEN 'keyword only #' || lr WHEN lr IS NULL THEN 'dense only #' || dr ELSE 'dense #' || dr || ' + keyword #' || lr END", "t.score", 6),
    "wander": f"""WITH RECURSIVE {_SIM}, {_BAND}, nx AS (SELECT seed_id AS a, id AS b FROM band WHERE pos = 9), wn AS (
        SELECT v.id AS seed_id, 1 AS step, a AS from_id, b AS id FROM v JOIN nx ON a = v.id
        UNION ALL SELECT seed_id, step + 1, a, b FROM wn JOIN nx ON a = wn.id WHERE step < 3) SELECT seed_id, step::INT AS step, from_id, id FROM wn""",
    "engine_list": """SELECT * FROM (VALUES ('band', 0, 'vectors', true), ('spread', 1, 'vectors', true), ('plain', 2, 'vectors', false), ('lexical', 3, 'texts', false),
        ('hybrid', 4, 'vectors,texts', true), ('echo', 5, 'vectors', true), ('concept', 6, 'links,edges', true), ('walk', 7, 'vectors', true), ('marks', 8, 'vectors,marks', true),
        ('structural', 9, 'vectors,second', true), ('fused', 10, 'vectors', true)) t(engine, place, needs, gated)""",
    "theme_embedding": f"WITH src AS (SELECT item_id AS id, text FROM benchmark), {_HASHED}",
    "corpus_embedding": f"WITH src AS (SELECT doc_id AS id, text FROM documents), {_HASHED}",
    "annotations_created": f"""WITH {_IMPORTED} SELECT quote_id, CASE WHEN times = 1 THEN book_id::VARCHAR ELSE 'book:' || book_id END AS target,
        CASE WHEN times = 1 THEN instr(text, quote) - 1 END::BIGINT AS start, CASE WHEN times = 1 THEN instr(text, quote) - 1 + length(quote) END::BIGINT AS "end",
        times <> 1 AS orphaned, CASE WHEN times = 1 THEN 1 END::INT AS n_chunks FROM an""",
    "import_counts": f"""WITH {_IMPORTED} SELECT book_id, sum((times = 1 AND book_id % 3 <> 0)::INT)::BIGINT AS imported, sum((times <> 1 AND book_id % 3 <> 0)::INT)::BIGINT AS orphaned,
        sum(1 + (book_id % 3 = 0)::INT)::BIGINT AS duplicate, 2 * count(*) AS total FROM an GROUP BY book_id""",
    "annotations_listed": "SELECT doc_id AS annotation_id, source || '#' || doc_id AS target FROM labels JOIN documents USING (doc_id) WHERE toxic IS DISTINCT FROM 1 AND doc_id % 5 <> 0",
    "book_annotations": """SELECT doc_id AS annotation_id, source AS book_id, row_number() OVER (PARTITION BY source ORDER BY source || '#' || doc_id, n_chars, doc_id)::INT AS pos
        FROM labels JOIN documents USING (doc_id)""",
    "mark_passages": """WITH m AS (SELECT doc_id AS n FROM labels), d AS (SELECT doc_id AS id FROM documents), c AS (
        SELECT n, CASE WHEN n % 3 = 0 THEN CASE WHEN n + 1 IN (SELECT id FROM d) THEN n + 1 WHEN n + 2 IN (SELECT id FROM d) THEN n + 2 END
          WHEN n % 3 = 1 AND n + 3 IN (SELECT id FROM d) THEN n + 3 END AS a, CASE WHEN n % 7 IN (SELECT id FROM d) THEN n % 7 END AS b FROM m)
      SELECT n AS mark_id, coalesce(a, b) AS id FROM c WHERE coalesce(a, b) IS NOT NULL""",
    "sparks_labelled": """SELECT doc_id AS passage_id, (quality = 1)::INT AS label, CASE WHEN quality = 1 THEN 'Reading rhythm drew you here — slow' END AS note FROM labels""",
    "selection_anchors": f"""WITH {_HELD}, s AS (SELECT quote_id || ':' || book_id AS span_id, quote, text, instr(text, quote) - 1 AS a FROM h)
      SELECT span_id, quote, substr(text, greatest(0, a - 32) + 1, a - greatest(0, a - 32)) AS prefix, substr(text, a + length(quote) + 1, 32) AS suffix FROM s""",
    "book_payload": """SELECT source AS book_id, row_number() OVER (PARTITION BY source ORDER BY doc_id)::INT AS pos, doc_id AS id, count(*) OVER (PARTITION BY source) AS n_chunks FROM documents""",
    "log_cleared": "SELECT user_id AS book, count(*) AS n FROM events WHERE user_id <> 7 GROUP BY user_id",
    "compare_basis": f"""WITH {_PLAIN}, {_STRUCT} SELECT s.seed_id, s.id, s.pos::INT AS pos, p.id IS NOT NULL AS shared FROM structural s LEFT JOIN plain p ON p.seed_id = s.seed_id AND p.id = s.id AND p.pos <= 8""",
    "doc_graph": f"""WITH {_CONCEPT}, pr AS (SELECT a.id AS seed_id, b.id, count(*) AS shared FROM cc a JOIN cc b ON a.label = b.label AND a.id <> b.id GROUP BY ALL HAVING count(*) >= 2)
      SELECT seed_id, id, shared, pos::INT AS pos FROM (SELECT *, row_number() OVER (PARTITION BY seed_id ORDER BY shared DESC, id) AS pos FROM pr) WHERE pos <= 4""",
    "section_heads": f"""WITH RECURSIVE {_SECTIONS} SELECT book_id, section::INT AS section, coalesce(arg_min(lang, id) FILTER (trim(lang) <> ''), '') AS heading,
        min(id % 97)::INT AS page_start, max(id % 97)::INT AS page_end FROM r JOIN documents ON doc_id = id GROUP BY ALL""",
}

# The concept walk.  `st` has each power of the matrix of two steps among nodes.
_BRIDGES = "SELECT doc_id AS id, source FROM labels JOIN documents USING (doc_id) WHERE quality = 1"


def _walks(concept: str, bridges: str) -> str:
    return f"""{concept}, l AS (
        SELECT id, label AS node, 1.0::DOUBLE AS w FROM cc UNION ALL SELECT id, 'edge:' || source, 1.5 FROM ({bridges})
      ), o AS (SELECT id, node, max(w) AS w FROM l GROUP BY ALL), c AS (SELECT node, count(*) AS n FROM o GROUP BY node
      ), gr AS (SELECT id, node, n, w / ln(2 + n) AS w FROM o JOIN c USING (node)
      ), sh AS (SELECT id, node, n, w / sum(w) OVER (PARTITION BY id) AS o, w / sum(w) OVER (PARTITION BY node) AS b FROM gr
      ), mv AS (SELECT x.node AS a, y.node AS b, sum(x.b * y.o) AS m FROM sh x JOIN sh y USING (id) GROUP BY ALL
      ), st AS (
        SELECT node AS a, node AS b, 1.0::DOUBLE AS m, 0 AS i FROM c
        UNION ALL SELECT st.a, mv.b, 0.85 * 0.85 * sum(st.m * mv.m), any_value(i) + 1 FROM st JOIN mv ON mv.a = st.b WHERE i < 14 GROUP BY st.a, mv.b)"""


def _activated(books: str) -> str:
    """Picks of every passage outside its own book."""
    return f"""tt AS (SELECT a, b, sum(m * CASE WHEN i = 14 THEN 0.85 ELSE 0.85 * 0.15 END) AS m FROM st GROUP BY ALL
      ), ms AS (SELECT id AS seed_id, tt.b AS node, sum(o * m) AS m FROM sh JOIN tt ON tt.a = node GROUP BY ALL
      ), ac AS (SELECT seed_id, id, 0.85 * sum(m * b) AS x FROM ms JOIN sh USING (node) GROUP BY ALL HAVING 0.85 * sum(m * b) >= 1e-6
      ), co AS (SELECT x.id AS seed_id, y.id, list(node ORDER BY y.n, node) AS concepts FROM sh x JOIN sh y USING (node) WHERE x.id <> y.id GROUP BY ALL
      ), pp AS (
        SELECT ac.seed_id, ac.id, round(x, 9) AS act, concepts, row_number() OVER (PARTITION BY ac.seed_id ORDER BY round(x, 9) DESC, ac.id) AS pos
        FROM ac JOIN co ON co.seed_id = ac.seed_id AND co.id = ac.id JOIN {books} p ON p.id = ac.seed_id JOIN {books} q ON q.id = ac.id WHERE p.book_id <> q.book_id)"""


_SOURCES = "(SELECT doc_id AS id, source AS book_id FROM documents)"
_IN_V = "FROM (SELECT d.* FROM documents d JOIN v ON v.id = d.doc_id)"
_WORDS = "regexp_extract_all(lower({}), '[a-z][a-z''\\-]{{2,}}')"

ORACLE_SQL |= {
    "concept_ppr": f"WITH RECURSIVE {_walks(_CONCEPT, _BRIDGES)}, {_activated(_SOURCES)} SELECT seed_id, id, act AS similarity, pos::INT AS pos FROM pp WHERE pos <= 8",
    "connect_concept": f"WITH RECURSIVE {_SIM}, {_walks(_CONCEPT.replace('FROM documents', _IN_V), _BRIDGES + ' AND doc_id IN (SELECT id FROM v)')}, {_activated('v')}, {_RANK} "
    + _contract("concept", "(SELECT * FROM pp WHERE pos <= 8)", "'via concepts: ' || array_to_string(list_transform(concepts[1:3], lambda x: CASE WHEN starts_with(x, 'edge:') THEN substr(x, 6) || ' (bridge)' ELSE x END), ', ')", "round(act::DECIMAL(18, 9), 6)::DOUBLE", 6),
    "concept_theme": f"""WITH RECURSIVE {_walks(_CONCEPT, _BRIDGES)}, tw AS (SELECT DISTINCT item_id AS seed_id, unnest({_WORDS.format("text")}) AS word FROM benchmark
      ), nw AS (SELECT DISTINCT node, unnest({_WORDS.format("regexp_replace(node, '^edge:', '')")}) AS word FROM c
      ), ma AS (SELECT DISTINCT seed_id, node FROM tw JOIN nw USING (word)), me AS (SELECT seed_id, node, 1.0 / count(*) OVER (PARTITION BY seed_id) AS e FROM ma
      ), tt AS (SELECT a, b, 0.15 * sum(m) AS m FROM st GROUP BY ALL), ms AS (SELECT seed_id, tt.b AS node, sum(e * m) AS m FROM me JOIN tt ON tt.a = node GROUP BY ALL
      ), ac AS (SELECT seed_id, id, round(0.85 * sum(m * b), 9) AS x FROM ms JOIN sh USING (node) GROUP BY ALL HAVING 0.85 * sum(m * b) >= 1e-6
      ), co AS (SELECT seed_id, id, array_to_string(list(node ORDER BY n, node), ', ') AS concepts FROM ma JOIN sh USING (node) GROUP BY ALL
      ), pp AS (SELECT *, row_number() OVER (PARTITION BY seed_id ORDER BY x DESC, id) AS pos FROM ac JOIN co USING (seed_id, id))
      SELECT seed_id, id, x AS similarity, pos::INT AS pos, concepts FROM pp WHERE pos <= 8""",
    "passage_graph": f"""WITH RECURSIVE {_CONCEPT.split("), g AS (")[0]}), gs AS (
        SELECT id, unnest(grams) AS gram, generate_subscripts(grams, 1) AS spot FROM (
          SELECT id, list_concat(t, list_transform(range(1, greatest(len(t), 1)::BIGINT), lambda i: t[i] || ' ' || t[i + 1])) AS grams FROM ct)
      ), gc AS (SELECT id, gram, count(*) AS n, min(spot) AS spot FROM gs GROUP BY ALL
      ), gk AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n DESC, spot) AS r FROM gc QUALIFY r <= 40
      ), go AS MATERIALIZED (SELECT id, gram, row_number() OVER (PARTITION BY id ORDER BY NOT contains(gram, ' '), r) AS r FROM gk
      ), pk AS (
        SELECT doc_id AS id, 0::BIGINT AS r, []::VARCHAR[] AS kept FROM documents
        UNION ALL SELECT pk.id, go.r, CASE WHEN len(kept) < 8 AND len(list_filter(kept, lambda x: contains(x, gram) OR contains(gram, x))) = 0 THEN list_append(kept, gram) ELSE kept END
        FROM pk JOIN go ON go.id = pk.id AND go.r = pk.r + 1
      ), ch AS (SELECT id, arg_max(kept, r) AS kept FROM pk GROUP BY id
      ), nd AS (SELECT id, unnest(kept) AS label, generate_subscripts(kept, 1) - 1 AS j FROM ch
      ), sp AS (SELECT doc_id AS id, string_split(regexp_replace(lower(text), '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)) AS ss FROM documents
      ), se AS (SELECT id, unnest(ss) AS s, generate_subscripts(ss, 1) AS spot FROM sp
      ), oc AS (SELECT id, j, spot FROM nd JOIN se USING (id) WHERE contains(s, label)
      ), ed AS (SELECT x.id, x.j AS a, y.j AS b, count(*) AS n, min(x.spot) AS first FROM oc x JOIN oc y ON x.id = y.id AND x.spot = y.spot AND x.j < y.j GROUP BY ALL
      ), ek AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n DESC, first, a, b) AS r FROM ed QUALIFY r <= 12
      ), es AS (SELECT id, string_agg(a || '-' || b || ':' || n, ', ' ORDER BY r) AS edges FROM ek GROUP BY id)
      SELECT id, array_to_string(kept, ', ') AS concepts, coalesce(edges, '') AS edges FROM ch LEFT JOIN es USING (id)""",
}

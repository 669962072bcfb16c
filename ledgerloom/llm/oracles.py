"""DuckDB SQL for the operators that SQL can express, written from their definitions."""

from __future__ import annotations

from . import fill_middle, importance, license_scan, line_dedup, url_filter

_LOWER = "translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all(" + _LOWER + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def url_verdicts() -> str:
    """Hosts, rules and the ratio of the two character models."""
    rules = sorted(url_filter.RULES, key=lambda r: (-len(r[1]), r[1]))
    fit = lambda r: f"(host = '{r.partition('/')[0]}' OR ends_with(host, '.{r.partition('/')[0]}')) AND starts_with(path, '/{r.partition('/')[2]}')"
    rule = " ".join(f"WHEN {fit(r)} THEN '{r}'" for _, r in rules)
    known = " ".join(f"WHEN '{r}' THEN '{v}'" for v, r in rules)
    order = url_filter.ORDER
    parts, base = [], "counted"
    for size in range(1, order + 2):
        at = order + 2 - size
        parts.append(f"n{size} AS (SELECT substr(gram, {at}, {size}) AS g, sum(allow) AS allow, sum(block) AS block FROM counted GROUP BY 1)")
        parts.append(f"c{size} AS (SELECT substr(g, 1, {size - 1}) AS c, sum(allow) AS allow_all, count_if(allow > 0) AS allow_kinds, sum(block) AS block_all, count_if(block > 0) AS block_kinds FROM n{size} GROUP BY 1)")
        low = {v: f"x.p_{v}" if size > 1 else f"(CAST(1 AS DOUBLE) / CAST({url_filter.SYMBOLS} AS DOUBLE))" for v in url_filter.MODELS}
        d = lambda c: f"CAST(coalesce({c}, 0) AS DOUBLE)"
        p = ", ".join(f"CASE WHEN {d(f'{v}_all')} > 0 THEN ({d(f'n.{v}')} + {d(f'{v}_kinds')} * {low[v]}) / ({d(f'{v}_all')} + {d(f'{v}_kinds')}) ELSE {low[v]} END AS p_{v}" for v in url_filter.MODELS)
        parts.append(f"p{size} AS (SELECT x.gram, {p} FROM {base} x LEFT JOIN n{size} n ON substr(x.gram, {at}, {size}) = n.g LEFT JOIN c{size} c ON substr(x.gram, {at}, {size - 1}) = c.c)")
        base = f"p{size}"
    return rf"""
        WITH r AS (SELECT page_id, url, coalesce(CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END, '') AS rest FROM pages),
        h AS (SELECT page_id, url, {_LOWER.format("regexp_extract(rest, '^([^/?#]*)', 1)")} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r),
        f AS (SELECT *, CASE {rule} END AS rule FROM h), k AS (SELECT *, CASE rule {known} END AS known FROM f),
        urls AS (SELECT url, any_value(known) AS known, count(*) AS times, CAST('0x' || substr(md5(url), 1, 8) AS BIGINT) % {url_filter.HELD_OUT} = 0 AS held, '{"^" * order}' || regexp_replace(regexp_replace({_LOWER.format("url")}, '[0-9]', '0', 'g'), '[^a-z0/.:-]', '?', 'g') AS s FROM k WHERE url <> '' GROUP BY url),
        grams AS (SELECT url, known, times, held, substr(s, i, {order + 1}) AS gram FROM (SELECT *, unnest(range(1, length(s) - {order} + 1)) AS i FROM urls)),
        counted AS (SELECT gram, sum(CASE WHEN known = 'allow' AND NOT held THEN times ELSE 0 END) AS allow, sum(CASE WHEN known = 'block' AND NOT held THEN times ELSE 0 END) AS block FROM grams GROUP BY 1),
        {", ".join(parts)},
        weights AS (SELECT gram, CAST(round((ln(p_allow) - ln(p_block)) * {url_filter.UNIT}) AS BIGINT) AS weight FROM {base}),
        scores AS (SELECT url, any_value(known) AS known, any_value(held) AS held, any_value(times) AS times, CAST(((sum(weight) + count(*) * {url_filter.SHIFT}) * 1000) // (count(*) * {url_filter.UNIT}) AS BIGINT) AS q FROM grams JOIN weights USING (gram) GROUP BY url),
        tallied AS (SELECT q, sum(CASE WHEN known = 'allow' THEN times ELSE 0 END) AS allow, sum(CASE WHEN known = 'block' THEN times ELSE 0 END) AS block FROM scores WHERE held AND known IS NOT NULL GROUP BY q),
        errors AS (SELECT q, coalesce(sum(allow) OVER w, 0) AS lost, sum(block) OVER () - coalesce(sum(block) OVER w, 0) AS let, sum(allow) OVER () AS allows, sum(block) OVER () AS blocks FROM tallied WINDOW w AS (ORDER BY q ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        t AS (SELECT coalesce((SELECT q FROM errors WHERE allows > 0 AND blocks > 0 ORDER BY let * allows + lost * blocks, q LIMIT 1), {url_filter.EVEN}) AS least)
        SELECT page_id, host, path, rule, coalesce(k.known, CASE WHEN coalesce(q, {url_filter.EVEN}) >= least THEN 'allow' ELSE 'block' END) AS verdict, CAST(coalesce(q, {url_filter.EVEN}) AS DOUBLE) / CAST(1000 AS DOUBLE) - CAST(32 AS DOUBLE) AS score
        FROM k CROSS JOIN t LEFT JOIN scores ON k.url = scores.url"""


def license_labels() -> str:
    """Phrases by comparing words at each place; notices by the word pairs of a template that stand at places a word or two apart."""
    same = lambda text: " AND ".join(f"w[p + {k}] = '{x}'" for k, x in enumerate(text.split()))
    phrases = [f"SELECT doc_id, p - 1 AS p, '{label}' AS label FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM w) WHERE {same(text)}" for text, label in license_scan.PHRASES]
    pairs = ", ".join(f"({k}, {t}, '{a} {b}')" for k, (text, _) in enumerate(license_scan.NOTICES) for t, (a, b) in enumerate(zip(text.split(), text.split()[1:])))
    info = ", ".join(f"({k}, '{label}', {len(text.split()) - 1}, {len(text.split())})" for k, (text, label) in enumerate(license_scan.NOTICES))
    return rf"""
        WITH w AS (SELECT doc_id, {_WORDS.format("text")} AS w FROM documents), pairs(template, t, x) AS (VALUES {pairs}), info(template, label, grams, size) AS (VALUES {info}),
        base AS ({" UNION ALL ".join(phrases)}),
        g AS (SELECT doc_id, p - 1 AS pos, w[p] || ' ' || w[p + 1] AS x FROM (SELECT doc_id, w, unnest(range(1, len(w))) AS p FROM w)),
        hits AS (SELECT DISTINCT doc_id, template, t, pos, pos - t AS diagonal FROM g JOIN pairs USING (x)),
        lanes AS (SELECT *, diagonal - lag(diagonal) OVER (PARTITION BY doc_id, template ORDER BY diagonal) AS step FROM (SELECT DISTINCT doc_id, template, diagonal FROM hits)),
        grouped AS (SELECT doc_id, template, diagonal, sum(CASE WHEN step IS NULL OR step > {license_scan.DRIFT} THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, template ORDER BY diagonal) AS grp FROM lanes),
        spans AS (SELECT h.doc_id, h.template, grp, count(DISTINCT t) AS covered, min(pos) AS start, max(pos) + 2 AS stop FROM hits h JOIN grouped USING (doc_id, template, diagonal) GROUP BY 1, 2, 3),
        ok AS (SELECT doc_id, label, covered, start, stop, covered / grams AS share FROM spans JOIN info USING (template) WHERE covered / grams >= {license_scan.COVERAGE} AND stop - start <= size + {2 * license_scan.DRIFT}),
        best AS (SELECT * FROM ok a WHERE NOT EXISTS (SELECT 1 FROM ok b WHERE b.doc_id = a.doc_id AND b.label <> a.label AND b.start < a.stop AND b.stop > a.start AND (b.share > a.share OR b.share = a.share AND b.covered > a.covered))),
        every AS (SELECT doc_id, label, share FROM best UNION ALL SELECT doc_id, label, 1 FROM base),
        firsts AS (SELECT doc_id, count(*) AS n_base, min(p) AS first_word, max(p) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM base GROUP BY doc_id),
        found AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score FROM every GROUP BY doc_id)
        SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CAST(coalesce(score, 0) AS DOUBLE) AS score
        FROM w LEFT JOIN firsts ON w.doc_id = firsts.doc_id LEFT JOIN found ON w.doc_id = found.doc_id"""


def lines_kept() -> str:
    """By the definition: every line of a run of enough words that stands earlier goes. Runs of so many lines hold a shorter one about each line."""
    least = line_dedup.LEAST_WORDS
    return rf"""
        WITH raw AS (SELECT doc_id AS id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents WHERE text IS NOT NULL),
        cleaned AS (SELECT id, pos, trim(regexp_replace({_LOWER.format("line")}, '[ \t\r]+', ' ', 'g')) AS c FROM raw),
        numbered AS (SELECT id, pos, c, length(c) - length(replace(c, ' ', '')) + 1 AS words, row_number() OVER (PARTITION BY id ORDER BY pos) AS n FROM cleaned WHERE c <> ''),
        lists AS (SELECT id, list(c ORDER BY n) AS cs, list(words ORDER BY n) AS ws FROM numbered GROUP BY id),
        runs AS (SELECT id, s, k, md5(array_to_string(cs[s:s + k - 1], chr(10))) AS x FROM (SELECT id, cs, ws, unnest(range(1, len(cs) + 1)) AS s FROM lists), range(1, {2 * least}) t(k) WHERE s + k - 1 <= len(cs) AND list_sum(ws[s:s + k - 1]) >= {least}),
        first AS (SELECT x, min(struct_pack(id := id, s := s)) AS f FROM runs GROUP BY x HAVING count(*) > 1),
        marks AS (SELECT DISTINCT id, unnest(range(s, s + k)) AS n FROM runs JOIN first USING (x) WHERE NOT (id = f.id AND s = f.s)),
        gone AS (SELECT id, pos FROM marks JOIN numbered USING (id, n)),
        kept AS (SELECT raw.id, string_agg(line, chr(10) ORDER BY raw.pos) FILTER (gone.id IS NULL) AS text, count(gone.id) AS n FROM raw LEFT JOIN gone ON raw.id = gone.id AND raw.pos = gone.pos GROUP BY 1)
        SELECT doc_id, coalesce(n, 0) AS n_lines_removed, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(kept.text, '') END AS text FROM documents d LEFT JOIN kept ON d.doc_id = kept.id"""


def _draw(seed: int, k: int) -> str:
    return f"CAST('0x' || substr(sha256('{seed}:' || coalesce(CAST(doc_id AS VARCHAR), '')), {8 * k + 1}, 8) AS BIGINT)"


def importance_ranks() -> str:
    """By the definition: the crc32 of each distinct word, byte by byte."""
    size = importance.BUCKETS
    counts = lambda table: f"(SELECT bucket, sum(n) AS n FROM (SELECT x, count(*) AS n FROM {table} GROUP BY x) JOIN crc USING (x) GROUP BY bucket)"
    d = lambda c: f"CAST({c} AS DOUBLE)"
    return rf"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS.format("text")} AS w FROM documents), dw AS (SELECT r, unnest(w) AS x FROM d),
        bw AS (SELECT unnest({_WORDS.format("text")}) AS x FROM benchmark),
        tab AS (SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN (c & 1) = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM (SELECT CAST(unnest(range(256)) AS BIGINT) AS i)),
        hexed AS (SELECT x, hex(encode(x)) AS h FROM (SELECT x FROM dw UNION SELECT x FROM bw)),
        crc AS (SELECT x, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, length(h), 2), lambda i: CAST('0x' || substr(h, i, 2) AS BIGINT))), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % {size} AS bucket FROM hexed, tab),
        s AS {counts("dw")}, t AS {counts("bw")}, sizes AS (SELECT (SELECT count(*) FROM dw) AS s_all, (SELECT count(*) FROM bw) AS t_all),
        gain AS (SELECT bucket, CAST(floor(1000 * ln({d("coalesce(t.n, 0) + 1")} * {d(f"s_all + {size}")} / ({d("s.n + 1")} * {d(f"t_all + {size}")}))) AS BIGINT) AS g FROM s LEFT JOIN t USING (bucket), sizes),
        weights AS (SELECT r, CAST(sum(g) AS BIGINT) AS weight FROM dw JOIN crc USING (x) JOIN gain USING (bucket) GROUP BY r),
        scored AS (SELECT r, doc_id, CAST(len(w) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln(({_draw(importance.SEED, 0)} + 0.5) / CAST(4294967296 AS DOUBLE)))) AS BIGINT) AS score FROM d LEFT JOIN weights USING (r)),
        ordered AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id) AS k, count(*) OVER () AS n FROM scored WHERE n_features >= {importance.LEAST_WORDS})
        SELECT doc_id, n_features, weight, score, CASE WHEN k <= {importance.PERCENT} * n // 100 THEN k END AS rank FROM scored LEFT JOIN ordered USING (r)"""


def rearranged() -> str:
    """Lists of lines, cut and joined."""
    p, s, m = fill_middle.PREFIX, fill_middle.SUFFIX, fill_middle.MIDDLE
    h = [_draw(fill_middle.SEED, k) for k in range(4)]
    return rf"""
        WITH l AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^
]*
|[^
]+') AS u FROM documents),
        c AS (SELECT *, CAST(len(u) AS BIGINT) AS n, least({h[0]} % (len(u) + 1), {h[1]} % (len(u) + 1)) AS a, greatest({h[0]} % (len(u) + 1), {h[1]} % (len(u) + 1)) AS b,
          CASE WHEN text = '' OR contains(text, '{p}') OR contains(text, '{s}') OR contains(text, '{m}') OR {h[2]} % 100 >= {fill_middle.RATE} THEN 'plain' WHEN {h[3]} % 100 < {fill_middle.SPM_RATE} THEN 'spm' ELSE 'psm' END AS form FROM l),
        x AS (SELECT *, array_to_string(u[1:a], '') AS pre, array_to_string(u[a + 1:b], '') AS mid, array_to_string(u[b + 1:], '') AS suf FROM c)
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
          sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '{p}' || pre || '{s}' || suf || '{m}' || mid ELSE '{s}' || suf || '{p}' || pre || '{m}' || mid END) AS output_sha256, sha256(text) AS restored_sha256 FROM x"""


ORACLES = {"op1_url_filter": url_verdicts(), "op3_license_scan": license_labels(), "op10_line_dedup": lines_kept(), "op12_importance_resampling": importance_ranks(), "op13_fill_in_middle": rearranged()}

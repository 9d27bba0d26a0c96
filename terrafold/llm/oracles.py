"""DuckDB SQL for the operators that SQL can express, over whole tables."""

from __future__ import annotations

from terrafold.llm.chat import CODES, HEAD, MARK, SELF, STOP
from terrafold.llm.urls import LOWER, RULES, TAIL, UPPER, Tree


def text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


# --- chats ---------------------------------------------------------------------------------------------------------


def chat_sql(conflict: str) -> str:
    plain = [a for a, _ in (SELF, *CODES)]
    extra = lambda c: " + ".join(f"(length({c}) - length(replace({c}, {text(p)}, '')))" for p in plain)
    codes = " OR ".join(f"contains(x, {text(b)})" for _, b in (SELF, *CODES))
    order = "ORDER BY turn NULLS FIRST, role, x"
    return f"""WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS x FROM conversations
  UNION ALL SELECT -7, 0, 'user', {text(conflict)} UNION ALL SELECT -7, 1, 'assistant', {text(conflict)}),
 e AS (SELECT *, contains(x, {text(HEAD)}) OR contains(x, {text(STOP)}) OR {codes} AS clash FROM t)
 SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || x || chr(10), '' {order})) AS turns_sha256,
 CAST(coalesce(sum(length(x)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(x, '' {order}) FILTER (role = 'assistant'), '')) AS loss_sha256,
 CAST(sum({len(HEAD) + len(MARK) + len(STOP) + 1} + length(role) + {extra('role')} + length(x) + CASE WHEN clash THEN {extra('x')} ELSE 0 END) AS BIGINT) AS formatted_chars,
 max(clash::INT) AS escape_level, TRUE AS identical FROM e GROUP BY conv_id"""


# --- URLs ----------------------------------------------------------------------------------------------------------


def url_sql(tree: Tree = Tree()) -> str:
    fits = lambda r: f"(host = {text(r.split('/')[0])} OR ends_with(host, {text('.' + r.split('/')[0])})) AND starts_with(path, {text('/' + r.split('/', 1)[1])})"
    longest = sorted(RULES, key=lambda r: (-len(r[1]), r[1]))
    rule = "CASE " + " ".join(f"WHEN {fits(r)} THEN {text(r)}" for _, r in longest) + " END"
    said = "CASE " + " ".join(f"WHEN {fits(r)} THEN {text(v)}" for v, r in longest) + " END"
    value = "regexp_replace(regexp_replace(s, '[0-9a-f]{8,}(-[0-9a-f]{4,})*', '{x}', 'g'), '[0-9]+', '{n}', 'g')"
    parts = [
        "u AS MATERIALIZED (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages)",
        f"h AS MATERIALIZED (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host FROM u)",
        "q AS MATERIALIZED (SELECT page_id, host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h)",
        f"p AS MATERIALIZED (SELECT *, {rule} AS rule, {said} AS said, list_transform(list_filter(string_split(path, '/'), lambda s: s <> ''), lambda s: {value}) AS segs FROM q)",
        "l0 AS MATERIALIZED (SELECT host, segs, count(*) AS n, count(said) AS labelled, count(*) FILTER (said = 'block') AS bad, '' AS template FROM p GROUP BY 1, 2)",
    ]
    for d in range(tree.depth + 1):
        seg = f"CASE WHEN len(segs) > {d} THEN '{TAIL}' END" if d == tree.depth else f"segs[{d + 1}]"
        share = "((all_bad + 0.5::DOUBLE) / (all_labelled + 1))"
        variable = f"(kids >= {tree.kids} AND c.n * kids <= {tree.heavy}::DOUBLE * all_n)"
        alike = f"(kids > 1 AND c.labelled > 0 AND abs(c.bad::DOUBLE / greatest(c.labelled, 1) - {share}) <= {tree.z}::DOUBLE * sqrt({share} * (1 - {share}) / greatest(c.labelled, 1)))"
        parts += [
            f"s{d} AS MATERIALIZED (SELECT *, {seg} AS seg FROM l{d})",
            f"c{d} AS MATERIALIZED (SELECT host, template, seg, sum(n) AS n, sum(labelled) AS labelled, sum(bad) AS bad FROM s{d} WHERE seg IS NOT NULL GROUP BY 1, 2, 3)",
            f"k{d} AS MATERIALIZED (SELECT host, template, count(*) AS kids, sum(n) AS all_n, sum(labelled) AS all_labelled, sum(bad) AS all_bad FROM c{d} GROUP BY 1, 2)",
            f"m{d} AS MATERIALIZED (SELECT c.host, c.template, c.seg, CASE WHEN {variable} OR {alike} THEN '*' ELSE c.seg END AS named FROM c{d} c JOIN k{d} k ON c.host = k.host AND c.template = k.template)",
            f"l{d + 1} AS MATERIALIZED (SELECT s.host, s.segs, s.n, s.labelled, s.bad, CASE WHEN m.named IS NULL THEN s.template ELSE s.template || '/' || m.named END AS template FROM s{d} s LEFT JOIN m{d} m ON s.host = m.host AND s.template = m.template AND s.seg = m.seg)",
        ]
    last = f"l{tree.depth + 1}"
    prior = f"(SELECT least(0.5::DOUBLE, coalesce(sum(bad)::DOUBLE / nullif(sum(labelled), 0), 0)) FROM {last})"
    parts.append(f"g AS MATERIALIZED (SELECT host, template, (sum(bad) + {tree.prior}::DOUBLE * {prior}) / (sum(labelled) + {tree.prior}::DOUBLE) AS purity FROM {last} GROUP BY 1, 2)")
    return f"""WITH {', '.join(parts)} SELECT p.page_id, p.host, p.path, p.rule, coalesce(p.said, CASE WHEN g.purity >= {tree.purity} THEN 'block' ELSE 'allow' END) AS verdict, t.template, round(g.purity, 9) AS purity
 FROM p JOIN {last} t ON p.host = t.host AND p.segs = t.segs JOIN g ON t.host = g.host AND t.template = g.template"""


# --- benchmark windows -----------------------------------------------------------------------------------------------

_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

DECONTAMINATION = f"""WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
 i AS (SELECT item_id, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
 win AS MATERIALIZED (SELECT DISTINCT item_id, n, array_to_string(w[p:p + n - 1], ' ') AS g FROM (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS p FROM i WHERE len(w) > 0)),
 starts AS (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n),
 hits AS MATERIALIZED (SELECT r, p, n, item_id FROM (SELECT r, p, n, array_to_string(w[p:p + n - 1], ' ') AS g FROM starts) JOIN win USING (n, g)),
 places AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(p, p + n)) AS q FROM hits) GROUP BY 1),
 items AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS s FROM hits GROUP BY 1)
 SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(s, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
 FROM d LEFT JOIN places USING (r) LEFT JOIN items USING (r)"""

# --- embeddings ------------------------------------------------------------------------------------------------------

EMBEDDINGS = """WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
 l AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
 r(node, other) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.node, l.b FROM r JOIN l ON l.a = r.other),
 c AS (SELECT node, min(other) AS component_id FROM r GROUP BY 1), n AS (SELECT a, count(*) AS n FROM l GROUP BY 1)
 SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(component_id, vec_id) AS component_id, vec_id = coalesce(component_id, vec_id) AS kept FROM embeddings LEFT JOIN c ON node = vec_id LEFT JOIN n ON a = vec_id"""

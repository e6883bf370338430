"""The registered queries in DuckDB's SQL, written apart from the engine: named steps, and a query over them."""

from __future__ import annotations

import re

#: Steps after which the iterations no longer change a rounded score.
STEPS = 200
_RECURSIVE = {"it": "(unit_idx, x, k)", "fwd": "(node)", "bwd": "(node)"}
_GROUPS = {1: (17, 26), 2: (15, 16, 21, 22, 25, 31), 3: (11, 13, 19, 23, 24), 4: (27, 28, 29, 30, 34, 35, 36), 5: (12, 14, 18, 20, 32, 33)}
_NAMES = ["Mathematics and Computer Science", "Physical Sciences and Engineering", "Life and Earth Sciences", "Biomedical and Health Sciences", "Social Sciences and Humanities"]
_CASE = "CASE " + " ".join(f"WHEN field_idx IN {m} THEN {k}" for k, m in _GROUPS.items()) + " END::BIGINT"
_CASE_NAME = "CASE " + " ".join(f"WHEN field_idx IN {_GROUPS[k + 1]} THEN '{n}'" for k, n in enumerate(_NAMES)) + " END"

W: dict[str, str] = {
    "auth": "SELECT l_orderkey work_idx, l_partkey author_idx, l_suppkey institution_idx FROM lineitem",
    "inst": "SELECT s_suppkey institution_idx, n_name country_code FROM supplier JOIN nation ON s_nationkey = n_nationkey",
    "src": "SELECT c_custkey source_idx, c_mktsegment type, c_name display_name FROM customer",
    "topic": "SELECT l_orderkey work_idx, substr(p_brand, 7)::BIGINT subfield_idx, p_brand subfield_name, substr(p_brand, 7)::BIGINT + 11 field_idx, l_quantity score FROM lineitem JOIN part ON l_partkey = p_partkey",
    "refs": "SELECT DISTINCT a.l_orderkey citer_idx, b.l_orderkey cited_idx FROM lineitem a JOIN lineitem b ON a.l_partkey = b.l_partkey AND a.l_orderkey > b.l_orderkey WHERE a.l_linenumber = 1 AND b.l_linenumber = 1",
    "works": """SELECT o_orderkey work_idx, o_custkey source_idx, year(o_orderdate)::BIGINT publication_year, o_orderpriority type, o_orderkey % 97 = 0 is_paratext, o_orderkey % 101 = 0 is_retracted,
  (o_custkey % 100)::VARCHAR || '-' || floor(o_totalprice / 50)::BIGINT::VARCHAR title, coalesce(g.n, 0) referenced_works_count, coalesce(c.n, 0) cited_by_count, coalesce(a.n, 0) authors_count, coalesce(a.m, 0) institutions_distinct_count
  FROM orders LEFT JOIN (SELECT citer_idx, count(*) n FROM refs GROUP BY 1) g ON citer_idx = o_orderkey LEFT JOIN (SELECT cited_idx, count(*) n FROM refs GROUP BY 1) c ON cited_idx = o_orderkey
  LEFT JOIN (SELECT work_idx, count(DISTINCT author_idx) n, count(DISTINCT institution_idx) m FROM auth GROUP BY 1) a ON a.work_idx = o_orderkey""",
    "picked": """SELECT * FROM works WHERE publication_year BETWEEN 1995 AND 2001 AND type IN ('1-URGENT', '2-HIGH', '3-MEDIUM', '5-LOW') AND NOT is_paratext AND NOT is_retracted AND referenced_works_count > 0
  AND title IS NOT NULL AND authors_count <= 29 AND source_idx IN (SELECT source_idx FROM src WHERE type IN ('HOUSEHOLD', 'FURNITURE', 'MACHINERY', 'BUILDING'))""",
    "corp": "SELECT * FROM picked QUALIFY dense_rank() OVER (PARTITION BY title ORDER BY publication_year, work_idx) = 1",
    "iw_all": """SELECT a.work_idx, a.institution_idx, max(country_code) country_code, sum(1.0::DOUBLE / na / ni) inst_weight, 1.0::DOUBLE / max(nw) direct_inst_weight FROM auth a JOIN inst USING (institution_idx)
  JOIN (SELECT work_idx, count(DISTINCT author_idx) na, count(DISTINCT institution_idx) nw FROM auth GROUP BY 1) USING (work_idx) JOIN (SELECT work_idx, author_idx, count(DISTINCT institution_idx) ni FROM auth GROUP BY 1, 2) USING (work_idx, author_idx) GROUP BY 1, 2""",
    "tw": "SELECT work_idx, subfield_idx, subfield_name, field_idx, sum(score) / sum(sum(score)) OVER (PARTITION BY work_idx) field_weight FROM topic GROUP BY 1, 2, 3, 4",
    "fw": f"""SELECT c.work_idx, publication_year, source_idx, institution_idx, country_code, inst_weight, direct_inst_weight, subfield_idx, subfield_name, field_idx, field_weight, {_CASE} leiden_idx, {_CASE_NAME} leiden_name,
  referenced_works_count, title, cited_by_count, authors_count, institutions_distinct_count FROM corp c JOIN iw_all USING (work_idx) JOIN tw USING (work_idx)""",
    "cr": "SELECT citer_idx, cited_idx FROM refs WHERE citer_idx IN (SELECT work_idx FROM corp) AND cited_idx IN (SELECT work_idx FROM corp)",
    "cs": "SELECT field_idx group_idx, source_idx, sum(field_weight) weighted_works FROM (SELECT DISTINCT work_idx, source_idx, field_idx, subfield_idx, field_weight FROM fw WHERE publication_year BETWEEN 1996 AND 2000) GROUP BY 1, 2",
    "cu": "SELECT field_idx group_idx, institution_idx, sum(field_weight * inst_weight) weighted_works FROM fw WHERE publication_year BETWEEN 1996 AND 2000 GROUP BY 1, 2",
    "gs": "SELECT source_idx, sum(field_weight) weighted_works FROM (SELECT DISTINCT work_idx, source_idx, subfield_idx, field_weight FROM fw WHERE leiden_idx = 4 AND publication_year BETWEEN 1996 AND 2000) GROUP BY 1",
    "gu": "SELECT institution_idx, sum(field_weight * inst_weight) weighted_works FROM fw WHERE leiden_idx = 4 AND publication_year BETWEEN 1996 AND 2000 GROUP BY 1",
    "fi": """SELECT work_idx, source_idx, institution_idx, max(inst_weight) inst_weight, max(direct_inst_weight) direct_inst_weight, sum(field_weight) field_weight FROM fw WHERE leiden_idx = 4 AND publication_year BETWEEN 1996 AND 2000
  AND source_idx IN (SELECT source_idx FROM gs WHERE weighted_works >= 0.25) AND institution_idx IN (SELECT institution_idx FROM gu WHERE weighted_works >= 2.5) GROUP BY 1, 2, 3""",
    "ww": "SELECT work_idx, max(field_weight) field_weight FROM fi GROUP BY 1",
    "pairs": "SELECT citer_idx, cited_idx, (a.field_weight + b.field_weight) / 2 efw FROM cr JOIN ww a ON a.work_idx = citer_idx JOIN ww b ON b.work_idx = cited_idx",
    "ri": "SELECT citer_idx, sum(efw) R_i FROM pairs GROUP BY 1",
    "el": """SELECT citer_idx citer_work_idx, a.source_idx citer_source_idx, a.institution_idx citer_inst_idx, a.inst_weight, a.direct_inst_weight, cited_idx cited_work_idx, b.source_idx cited_source_idx, b.institution_idx cited_inst_idx,
  b.inst_weight cited_inst_weight, b.direct_inst_weight direct_cited_inst_weight, efw edge_field_weight, R_i FROM pairs JOIN ri USING (citer_idx) JOIN fi a ON a.work_idx = citer_idx JOIN fi b ON b.work_idx = cited_idx""",
    "eps": """SELECT * FROM el UNION ALL SELECT citer_idx, source_idx, institution_idx, inst_weight, direct_inst_weight, cited_idx, 1000000000000, 1000000000000, 1.0, 1.0, (SELECT field_weight FROM ww w WHERE w.work_idx = fi.work_idx) / 2, R_i
  FROM cr JOIN fi ON work_idx = citer_idx JOIN ri USING (citer_idx) WHERE cited_idx NOT IN (SELECT work_idx FROM ww)
  UNION ALL SELECT citer_idx, 1000000000000, 1000000000000, 1.0, 1.0, cited_idx, fi.source_idx, institution_idx, inst_weight, direct_inst_weight, w.field_weight / 2, t.R_i FROM cr JOIN fi ON work_idx = cited_idx JOIN ww w ON w.work_idx = cited_idx
  JOIN (SELECT citer_idx, sum(field_weight / 2) R_i FROM cr JOIN ww ON work_idx = cited_idx WHERE citer_idx NOT IN (SELECT work_idx FROM ww) GROUP BY 1) t USING (citer_idx)""",
    "ew": "SELECT *, CASE WHEN R_i = 0 THEN 0 ELSE edge_field_weight * (SELECT avg(R_i) FROM (SELECT DISTINCT citer_work_idx, R_i FROM el)) / R_i END ew FROM el",
    "us": "SELECT source_idx unit_idx, weighted_works a_p FROM gs WHERE weighted_works >= 0.25 AND source_idx IN (SELECT citer_source_idx FROM el UNION SELECT cited_source_idx FROM el)",
    "uu": "SELECT institution_idx unit_idx, weighted_works a_p FROM gu WHERE weighted_works >= 2.5 AND institution_idx IN (SELECT citer_inst_idx FROM el UNION SELECT cited_inst_idx FROM el)",
    "ss": "SELECT citer_source_idx src, cited_source_idx dst, sum(ew) w FROM (SELECT DISTINCT citer_work_idx, citer_source_idx, cited_work_idx, cited_source_idx, ew FROM ew) GROUP BY 1, 2",
    "si": "SELECT citer_source_idx src, cited_inst_idx dst, sum(ew * cited_inst_weight) w FROM (SELECT DISTINCT citer_work_idx, citer_source_idx, cited_work_idx, cited_inst_idx, cited_inst_weight, ew FROM ew) GROUP BY 1, 2",
    "iss": "SELECT citer_inst_idx src, cited_source_idx dst, sum(ew * inst_weight) w FROM (SELECT DISTINCT citer_work_idx, citer_inst_idx, cited_work_idx, cited_source_idx, inst_weight, ew FROM ew) GROUP BY 1, 2",
    "ii": "SELECT citer_inst_idx src, cited_inst_idx dst, sum(ew * inst_weight * cited_inst_weight) w FROM ew GROUP BY 1, 2",
    "fields": "SELECT DISTINCT field_idx FROM topic",
    "rk": """SELECT field_idx, source_idx unit_idx, 'S' unit_type, ((source_idx * 7 + field_idx * 3) % 20) / 10.0::DOUBLE v FROM src, fields WHERE (source_idx + field_idx) % 11 <> 0
  UNION ALL SELECT field_idx, institution_idx, 'U', ((institution_idx * 7 + field_idx * 3) % 20) / 10.0::DOUBLE FROM inst, fields WHERE (institution_idx + field_idx) % 11 <> 0""",
    "wv": """SELECT work_idx, f.field_idx, max(s.v) source_v, avg(u.v) mean_inst_v, (max(s.v) + coalesce(avg(u.v), max(s.v))) / 2 work_v FROM (SELECT DISTINCT work_idx, field_idx, source_idx, institution_idx FROM fw) f
  JOIN rk s ON s.unit_type = 'S' AND s.field_idx = f.field_idx AND s.unit_idx = source_idx LEFT JOIN rk u ON u.unit_type = 'U' AND u.field_idx = f.field_idx AND u.unit_idx = institution_idx GROUP BY 1, 2""",
    "cc": """SELECT d.field_idx, d.work_idx, count(*) n_intra, avg(c.v) mean_citer_v, count(*) FILTER (c.v > 1) n_citer_hi, count(*) FILTER (c.v < 1) n_citer_lo FROM cr JOIN (SELECT work_idx, max(source_v) v FROM wv GROUP BY 1) c ON c.work_idx = citer_idx
  JOIN wv d ON d.work_idx = cited_idx GROUP BY 1, 2""",
    "fl": """SELECT *, n_intra >= threshold is_hcw FROM (SELECT field_idx, work_idx, publication_year, source_v, mean_citer_v, coalesce(n_intra, 0) n_intra, quantile_cont(coalesce(n_intra, 0), 0.9) OVER (PARTITION BY field_idx, publication_year) threshold
  FROM wv JOIN picked USING (work_idx) LEFT JOIN cc USING (field_idx, work_idx))""",
    "qd": "SELECT field_idx, work_idx, CASE WHEN source_v >= 1 THEN '+' WHEN source_v < 1 THEN '-' END || CASE WHEN mean_citer_v >= 1 THEN '+' WHEN mean_citer_v < 1 THEN '-' END quadrant FROM fl",
}


def sql(body: str, **more: str) -> str:
    """body with the steps that it names, and those that they name, before it."""
    steps, order, open_ = W | more, [], set()

    def need(text: str) -> None:
        for name in steps:
            if name not in order and name not in open_ and re.search(rf"\b(FROM|JOIN|,)\s+{name}\b", text):
                open_.add(name)
                need(steps[name])
                order.append(name)

    need(body)
    recursive = "RECURSIVE " if set(order) & set(_RECURSIVE) else ""
    return f"WITH {recursive}" + ",\n".join(f"{n}{_RECURSIVE.get(n, '')} AS ({steps[n]})" for n in order) + "\n" + body


def _giant(edges: str) -> dict[str, str]:
    """The strong component of the node of most ways through it: what it reaches and what reaches it. Nearly all nodes lie in it."""
    return {
        "eb": edges, "pv": "SELECT a.node FROM (SELECT src node, count(*) o FROM eb GROUP BY 1) a JOIN (SELECT dst node, count(*) i FROM eb GROUP BY 1) b ON a.node = b.node ORDER BY o * i DESC, a.node LIMIT 1",
        "fwd": "SELECT node FROM pv UNION SELECT dst FROM fwd JOIN eb ON src = node", "bwd": "SELECT node FROM pv UNION SELECT src FROM bwd JOIN eb ON dst = node",
        "scc": "SELECT node FROM fwd INTERSECT SELECT node FROM bwd",
        "h": "SELECT src, dst, w / sum(w) OVER (PARTITION BY src) w FROM eb WHERE src IN (SELECT node FROM scc) AND dst IN (SELECT node FROM scc)",
    }


def _power(edges: str, units: str, alpha: float = 1.0, prior: str = "1.0::DOUBLE / (SELECT count(*) FROM u)", start: str = "u", steps: int = STEPS) -> dict[str, str]:
    """The Perron vector, or the series of damped steps from the prior, over the giant component of edges."""
    return _giant(edges) | {
        "u": f"SELECT * FROM {units} WHERE unit_idx IN (SELECT node FROM scc)",
        "it": f"SELECT unit_idx, {prior}, 0 FROM {start} UNION ALL SELECT dst, sum({alpha} * w * x), k + 1 FROM it JOIN h ON src = it.unit_idx WHERE k < {steps} GROUP BY dst, k",
        "raw": f"SELECT unit_idx, sum(CASE WHEN k = {steps} THEN x ELSE {1 - alpha} * x END) x FROM it WHERE k = {steps} OR {alpha} < 1 GROUP BY 1",
        "pi": "SELECT u.unit_idx, a_p, coalesce(x, 0) / (SELECT sum(x) FROM raw) pi FROM u LEFT JOIN raw USING (unit_idx)",
    }


_BLOCKS = {"ii": "SELECT src, dst, w FROM ii", "ss": "SELECT src, dst, w FROM ss", "bi": "SELECT 2 * src src, 2 * dst + 1 dst, w FROM si UNION ALL SELECT 2 * src + 1, 2 * dst, w FROM iss"}
_CHI = "(SELECT count(*) FILTER (node % 2 = 1) / count(*)::DOUBLE c FROM scc)"
_FOLDED = {"ju": "SELECT 2 * unit_idx unit_idx, a_p FROM us UNION ALL SELECT 2 * unit_idx + 1, a_p FROM uu"}
_JOINT = _FOLDED | _power("SELECT 2 * src src, 2 * dst dst, w, 0 cross_ FROM ss UNION ALL SELECT 2 * src, 2 * dst + 1, w, 1 FROM si UNION ALL SELECT 2 * src + 1, 2 * dst, w, 1 FROM iss UNION ALL SELECT 2 * src + 1, 2 * dst + 1, w, 0 FROM ii", "ju")
_JOINT["h"] = f"SELECT src, dst, w / sum(w) OVER (PARTITION BY src) w FROM (SELECT src, dst, CASE cross_ WHEN 1 THEN c * (1 - c) * w ELSE w END w FROM eb, {_CHI} WHERE src IN (SELECT node FROM scc) AND dst IN (SELECT node FROM scc))"
# from sources to institutions and back: even steps stand on sources; the last one and the step after it are the two sides
_BI = _FOLDED | _power(_BLOCKS["bi"], "ju", prior="1.0::DOUBLE / (SELECT count(*) FROM u WHERE unit_idx % 2 = 0)", start="u WHERE unit_idx % 2 = 0", steps=2 * STEPS + 1) | {
    "raw": f"SELECT unit_idx, x FROM it WHERE k >= {2 * STEPS}",
    "pi": "SELECT u.unit_idx, a_p, coalesce(x, 0) / (2 * sum(coalesce(x, 0)) OVER (PARTITION BY u.unit_idx % 2)) pi FROM u LEFT JOIN raw USING (unit_idx)",
}


def _damped(prior: str, alpha: float = 0.85) -> dict[str, str]:
    """Both sides under a prior (of a unit t of u, given ns and nu): the series of two hops each, then the institutions by one more."""
    counts = "SELECT count(*) FILTER (unit_idx % 2 = 0) ns, count(*) FILTER (unit_idx % 2 = 1) nu FROM u"
    return _FOLDED | _power(_BLOCKS["bi"], "ju") | {
        "n": counts, "mu": f"SELECT unit_idx, {prior} m FROM u, n",
        "m0": f"SELECT unit_idx, m FROM mu WHERE unit_idx % 2 = 0 UNION ALL SELECT dst, {alpha} * w * m FROM h JOIN mu ON src = unit_idx WHERE unit_idx % 2 = 1",
        "m1": "SELECT unit_idx, sum(m) / (SELECT sum(m) FROM m0) m FROM m0 GROUP BY 1",
        "it": f"SELECT unit_idx, m, 0 FROM m1 UNION ALL SELECT dst, sum({alpha} * w * x), k + 1 FROM it JOIN h ON src = it.unit_idx WHERE k < {2 * STEPS} GROUP BY dst, k",
        "raw": f"SELECT unit_idx, {1 - alpha * alpha} * sum(x) x FROM it WHERE k % 2 = 0 GROUP BY 1",
        "ru": f"SELECT unit_idx, sum(x) x FROM (SELECT dst unit_idx, {alpha} * w * x x FROM raw JOIN h ON src = unit_idx UNION ALL SELECT unit_idx, {1 - alpha} * m FROM mu WHERE unit_idx % 2 = 1) GROUP BY 1",
        "pi": "SELECT u.unit_idx, a_p, coalesce(r.x, 0) / (2 * sum(coalesce(r.x, 0)) OVER (PARTITION BY u.unit_idx % 2)) pi FROM u LEFT JOIN (SELECT * FROM raw UNION ALL SELECT * FROM ru) r USING (unit_idx)",
    }


_SIDES = "SELECT CASE unit_idx % 2 WHEN 0 THEN 'S' ELSE 'U' END unit_type, unit_idx // 2 unit_idx, round(pi, 9) pi FROM pi"
# v by the definition: pi over size, over the same of all units; where a run has a sentinel, of all others
_V = "round((pi / a_p) / (sum(pi) OVER () / sum(a_p) OVER ()), 6) v"
_SIDED = "SELECT CASE unit_idx % 2 WHEN 0 THEN 'S' ELSE 'U' END unit_type, unit_idx // 2 unit_idx, pi, a_p FROM pi"
_RANKED = f"SELECT unit_idx, unit_type, round(pi, 9) pi, {_V} FROM ({_SIDED})"
_REAL = "FILTER (unit_idx <> 1000000000000) OVER ()"
_SENTINEL_RANKED = f"SELECT unit_idx, unit_type, round(pi, 9) pi, CASE WHEN unit_idx <> 1000000000000 THEN round((pi / a_p) / (sum(pi) {_REAL} / sum(a_p) {_REAL}), 6) END v FROM ({_SIDED})"
_SENTINEL = _BI | {
    "ew": W["ew"].replace(" el", " eps"), "us": W["us"].replace(" el", " eps") + " UNION ALL SELECT 1000000000000, 1.0", "uu": W["uu"].replace(" el", " eps") + " UNION ALL SELECT 1000000000000, 1.0",
    "scc": "(SELECT node FROM fwd INTERSECT SELECT node FROM bwd) UNION SELECT 2000000000000 UNION SELECT 2000000000001",
}


def of_group(body: str, group: int) -> str:
    """The same query for another group."""
    return body.replace("leiden_idx = 4", f"leiden_idx = {group}")


_BLOC = "work_idx NOT IN (SELECT work_idx FROM fw WHERE leiden_idx = 4 AND publication_year BETWEEN 1996 AND 2000 AND country_code NOT IN (" + ", ".join(f"'NATION_{k}'" for k in range(20)) + "))"
_IN_BLOC = {"fi": W["fi"].replace(" GROUP BY 1, 2, 3", f" AND {_BLOC} GROUP BY 1, 2, 3")}
_RE = lambda c: f"round({c}, 9) {c.split('.')[-1]}"
_EL = "citer_work_idx, citer_source_idx, citer_inst_idx, round(inst_weight, 9) inst_weight, round(direct_inst_weight, 9) direct_inst_weight, cited_work_idx, cited_source_idx, cited_inst_idx, round(cited_inst_weight, 9) cited_inst_weight, round(direct_cited_inst_weight, 9) direct_cited_inst_weight, round(edge_field_weight, 9) edge_field_weight, round(R_i, 9) R_i"
_KEYS = "SELECT p_partkey id, split_part(p_name, ' ', 1) f, split_part(p_name, ' ', 2) l, substr(p_name, 1, 1) fi, p_brand m FROM part"
_TOK = "SELECT p_partkey id, list_distinct(list_filter(string_split(regexp_replace(lower(p_name || ' ' || p_brand || ' ' || p_type), '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: x <> '')) t FROM part"

SQL: dict[str, str] = {
    "work_filter_semi": sql("SELECT work_idx, source_idx, publication_year, title FROM picked"),
    "title_dedup": sql("SELECT work_idx, title FROM works QUALIFY dense_rank() OVER (PARTITION BY title ORDER BY publication_year, work_idx) = 1"),
    "inst_weights": sql(f"SELECT work_idx, institution_idx, country_code, {_RE('inst_weight')}, {_RE('direct_inst_weight')} FROM iw_all"),
    "topic_weights": sql(f"SELECT work_idx, subfield_idx, subfield_name, field_idx, {_RE('field_weight')} FROM tw"),
    "taxonomy_case": sql(f"SELECT DISTINCT field_idx, {_CASE} leiden_idx, {_CASE_NAME} leiden_name FROM topic"),
    "flat_works": sql("SELECT * REPLACE (round(inst_weight, 9) AS inst_weight, round(direct_inst_weight, 9) AS direct_inst_weight, round(field_weight, 9) AS field_weight) FROM fw"),
    "corpus_refs": sql("SELECT citer_idx, cited_idx FROM cr"),
    "refs_nested_explode": sql("SELECT citer_idx, cited_idx FROM refs WHERE citer_idx IN (SELECT work_idx FROM picked) AND cited_idx IN (SELECT work_idx FROM picked)"),
    "cand_source": sql(f"SELECT group_idx, source_idx, {_RE('weighted_works')} FROM cs"),
    "cand_inst": sql(f"SELECT group_idx, institution_idx, {_RE('weighted_works')} FROM cu"),
    "cand_rollup": sql("SELECT g group_idx, institution_idx, round(sum(weighted_works), 9) weighted_works FROM cu JOIN (SELECT 1 g, unnest(range(11, 25)) f UNION ALL SELECT 2, unnest(range(20, 37))) v ON group_idx = f GROUP BY 1, 2"),
    "retained_units_whitelist": sql("SELECT 'S' unit_type, source_idx unit_idx, round(weighted_works, 9) weighted_works FROM gs WHERE weighted_works >= 1.5 OR source_idx % 10 = 0 AND weighted_works >= 0.2 UNION ALL SELECT 'U', institution_idx, round(weighted_works, 9) FROM gu WHERE weighted_works >= 2.5"),
    "bloc_excluded_works": sql("SELECT DISTINCT work_idx FROM fw WHERE leiden_idx = 4 AND publication_year BETWEEN 1996 AND 2000 AND country_code NOT IN (" + ", ".join(f"'NATION_{k}'" for k in range(20)) + ")"),
    "work_pairs": sql("SELECT citer_idx citer_work_idx, cited_idx cited_work_idx, round(efw, 9) edge_field_weight FROM pairs"),
    "ref_sums": sql("SELECT citer_idx citer_work_idx, round(R_i, 9) R_i FROM ri"),
    "edge_list_plain": sql(f"SELECT {_EL} FROM el"),
    "edge_list_epsilon": sql(f"SELECT {_EL} FROM eps"),
    "active_units": sql("SELECT 'S' unit_type, unit_idx, round(a_p, 9) a_p FROM us UNION ALL SELECT 'U', unit_idx, round(a_p, 9) FROM uu"),
    "block_ss": sql("SELECT src, dst, round(w, 9) w FROM ss"),
    "block_si": sql("SELECT src, dst, round(w, 9) w FROM si"),
    "block_is": sql("SELECT src, dst, round(w, 9) w FROM iss"),
    "block_ii": sql("SELECT src, dst, round(w, 9) w FROM ii"),
    "block_is_rho1": sql("SELECT citer_inst_idx src, cited_source_idx dst, round(sum(e * iw), 9) w FROM (SELECT DISTINCT citer_work_idx, citer_inst_idx, cited_work_idx, cited_source_idx, inst_weight iw, edge_field_weight e FROM el) GROUP BY 1, 2"),
    "block_si_omega1": sql("SELECT citer_source_idx src, cited_inst_idx dst, round(sum(ew * iw), 9) w FROM (SELECT DISTINCT citer_work_idx, citer_source_idx, cited_work_idx, cited_inst_idx, direct_cited_inst_weight iw, ew FROM ew) GROUP BY 1, 2"),
    "block_ii_beta1": sql("SELECT citer_inst_idx src, cited_inst_idx dst, round(sum(ew * inst_weight * cited_inst_weight), 9) w FROM ew WHERE NOT (citer_source_idx = cited_source_idx AND citer_inst_idx = cited_inst_idx) GROUP BY 1, 2"),
    "power_ii": sql("SELECT unit_idx, round(pi, 9) pi FROM pi", **_power(_BLOCKS["ii"], "uu")),
    "power_ss": sql("SELECT unit_idx, round(pi, 9) pi FROM pi", **_power(_BLOCKS["ss"], "us")),
    "katz_uniform": sql("SELECT unit_idx, round(pi, 9) pi FROM pi", **_power(_BLOCKS["ii"], "uu", 0.85)),
    "katz_by_size": sql("SELECT unit_idx, round(pi, 9) pi FROM pi", **_power(_BLOCKS["ii"], "uu", 0.85, "a_p / (SELECT sum(a_p) FROM u)")),
    "bipartite_perron": sql(_SIDES, **_BI),
    "bipartite_uniform": sql(_SIDES, **_damped("1.0::DOUBLE / (ns + nu)")),
    "bipartite_unit_scaled": sql(_SIDES, **_damped("0.5::DOUBLE / CASE unit_idx % 2 WHEN 0 THEN ns ELSE nu END")),
    "bipartite_resolvent": sql(_SIDES, **(_FOLDED | _power(_BLOCKS["bi"], "ju", 0.85**0.5, steps=600))),
    "joint_chi": sql("SELECT unit_idx, round(pi, 9) pi FROM pi", **_JOINT),
    "rank_by_mask": sql(_RANKED, **_BI),
    "rank_joint": sql(_RANKED, **_JOINT),
    "rank_sources": sql(f"SELECT unit_idx, 'S' unit_type, round(pi, 9) pi, {_V} FROM pi", **_power(_BLOCKS["ss"], "us")),
    "rank_dense": sql(f"SELECT *, dense_rank() OVER (ORDER BY pi DESC)::INT rank_pi, dense_rank() OVER (ORDER BY v DESC NULLS LAST)::INT rank_v FROM (SELECT unit_idx, 'U' unit_type, round(pi, 9) pi, {_V} FROM pi)", **_power(_BLOCKS["ii"], "uu")),
    "rank_sentinel": sql(_SENTINEL_RANKED, **_SENTINEL),
    # a group without any cycle has no giant component, and no ranking: its one pivot keeps no score
    "sweep_blocs": " UNION ALL ".join(f"SELECT '{run}' run, {g}::BIGINT group_idx, * FROM ({of_group(sql(_RANKED, **(_BI | more)), g)}) WHERE isfinite(pi)" for run, more in (("world", {}), ("bloc", _IN_BLOC)) for g in _GROUPS),
    "giant_scc": sql("SELECT node FROM scc", **_giant(_BLOCKS["ss"])),
    "work_v": sql("SELECT work_idx, field_idx, round(source_v, 9) source_v, round(mean_inst_v, 9) mean_inst_v, round(work_v, 9) work_v FROM wv"),
    "citer_counts": sql("SELECT field_idx, work_idx, n_intra, round(mean_citer_v, 9) mean_citer_v, n_citer_hi, n_citer_lo FROM cc"),
    "hcw_flags": sql("SELECT field_idx, work_idx, publication_year, n_intra, round(threshold, 9) threshold, is_hcw FROM fl"),
    "quadrants": sql("SELECT field_idx, work_idx, quadrant FROM qd"),
    "quadrant_pools": sql("SELECT field_idx, " + ", ".join(f"count(*) FILTER (quadrant = '{q}') {n}" for q, n in (("++", "n_pp"), ("+-", "n_pm"), ("-+", "n_mp"), ("--", "n_mm"))) + " FROM qd GROUP BY 1"),
    "hcw_pctile_overrides": sql("SELECT field_idx, round(CASE field_idx WHEN 12 THEN quantile_cont(n, 0.9) WHEN 20 THEN quantile_cont(n, 0.5) ELSE quantile_cont(n, 0.99) END, 9) threshold FROM (SELECT DISTINCT field_idx, work_idx, cited_by_count n FROM fw) GROUP BY 1"),
    "field_shares": sql("SELECT work_idx, field_idx, round(sum(score) / sum(sum(score)) OVER (PARTITION BY work_idx), 3) share FROM topic GROUP BY 1, 2"),
    "author_counts_mode": sql("SELECT author_idx, institution_idx, count(*) n FROM auth GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY author_idx ORDER BY count(*) DESC, institution_idx) = 1"),
    "surrogate_key": sql("SELECT author_idx, n_works, row_number() OVER (ORDER BY n_works DESC, author_idx)::INT AS key FROM (SELECT author_idx, count(DISTINCT work_idx) n_works FROM auth GROUP BY 1)"),
    "crossfield_scores": sql(
        "SELECT author_idx, coalesce(nf, 0) n_fields, round(coalesce(ps, 0), 6) cf_paper_score, round(coalesce(qs, 0), 6) cf_cite_score, coalesce(ps, 0) >= 1 AND coalesce(qs, 0) >= 1 qualified FROM paper_s FULL JOIN cite_s USING (author_idx)",
        held="SELECT DISTINCT field_idx, author_idx, work_idx, cited_by_count FROM auth JOIN fw USING (work_idx)",
        paper_n="SELECT field_idx, author_idx, count(*)::DOUBLE n FROM held WHERE cited_by_count > 0 GROUP BY 1, 2",
        cite_n="SELECT field_idx, author_idx, sum(cited_by_count)::DOUBLE n FROM held GROUP BY 1, 2",
        **{f"{x}_t": f"SELECT field_idx, greatest(1, l[1 + floor(h)::INT] + (l[1 + ceil(h)::INT] - l[1 + floor(h)::INT]) * (h - floor(h))) t FROM (SELECT field_idx, list(n ORDER BY n) l, (count(*) - 1) * greatest(0, 1 - 20.0::DOUBLE / count(*)) h FROM {x}_n GROUP BY 1)" for x in ("paper", "cite")},
        paper_s="SELECT author_idx, sum(n / t) ps, count(*) nf FROM paper_n JOIN paper_t USING (field_idx) GROUP BY 1",
        cite_s="SELECT author_idx, sum(n / t) qs FROM cite_n JOIN cite_t USING (field_idx) GROUP BY 1",
    ),
    "coauthor_evidence": sql(
        "SELECT x.cluster, x.a, x.b, coalesce(u.n, 0) n_a, coalesce(v.n, 0) n_b, coalesce(s.n, 0) n_shared, round(coalesce(s.n, 0) / greatest(1, coalesce(u.n, 0) + coalesce(v.n, 0) - coalesce(s.n, 0))::DOUBLE, 9) jaccard FROM pr x LEFT JOIN nc u ON u.author_idx = a LEFT JOIN nc v ON v.author_idx = b LEFT JOIN sh s ON s.a = x.a AND s.b = x.b",
        cl="SELECT DISTINCT author_idx // 10 cluster, author_idx FROM auth",
        pr="SELECT p.cluster, p.author_idx a, r.author_idx b FROM cl p JOIN cl r ON p.cluster = r.cluster AND p.author_idx < r.author_idx",
        co="SELECT DISTINCT m.author_idx, o.author_idx c FROM auth m JOIN auth o USING (work_idx) WHERE m.author_idx <> o.author_idx AND m.author_idx IN (SELECT author_idx FROM cl)",
        nc="SELECT author_idx, count(*) n FROM co GROUP BY 1",
        sh="SELECT a, b, count(*) n FROM pr JOIN co k ON k.author_idx = a JOIN co m ON m.author_idx = b AND m.c = k.c GROUP BY 1, 2",
    ),
    "seed_citations": sql("SELECT citer_idx, cited_idx FROM cr WHERE cited_idx IN (SELECT work_idx FROM works WHERE cited_by_count >= 3)"),
    "top_researchers": sql("SELECT field_idx, quadrant enclave, author_idx, count(DISTINCT work_idx) n_works, row_number() OVER (PARTITION BY field_idx, quadrant ORDER BY count(DISTINCT work_idx) DESC, author_idx)::INT AS rank FROM qd JOIN auth USING (work_idx) WHERE quadrant IS NOT NULL GROUP BY 1, 2, 3 QUALIFY rank <= 3"),
    "unit_rank_share": sql(
        "SELECT group_idx, count(*) n_units, " + ", ".join(f"round(sum(weighted_works) FILTER (r <= {k}) / sum(weighted_works), 9) top_{k}" for k in (1, 10, 50)) + " FROM (SELECT *, row_number() OVER (PARTITION BY group_idx ORDER BY round(weighted_works, 9) DESC, institution_idx) r FROM cu) x GROUP BY 1"
    ),
    "cross_field_pairs": sql("SELECT a.field_idx field_a, b.field_idx field_b, count(*) n_works FROM f a JOIN f b ON a.work_idx = b.work_idx AND a.field_idx < b.field_idx GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 20", f="SELECT DISTINCT work_idx, field_idx FROM fw"),
    "country_report": sql("SELECT country_code, count(DISTINCT work_idx) n_works, count(DISTINCT institution_idx) n_inst, count(DISTINCT source_idx) n_sources, count(DISTINCT CASE WHEN publication_year >= 2000 THEN work_idx END) n_recent, count(DISTINCT CASE WHEN leiden_idx = 4 THEN work_idx END) n_health FROM fw GROUP BY 1"),
    "share_by_year": sql(
        "SELECT country_code, " + ", ".join(f"round(max(k / n::DOUBLE) FILTER (y = {y}), 9) y{y}" for y in range(1995, 2002)) + ", coalesce(sum(k) FILTER (y < 1999), 0)::BIGINT early, coalesce(sum(k) FILTER (y >= 1999), 0)::BIGINT late, CASE WHEN sum(k) FILTER (y < 1999) > 0 THEN round(coalesce(sum(k) FILTER (y >= 1999), 0) / sum(k) FILTER (y < 1999)::DOUBLE - 1, 9) END growth FROM c JOIN n USING (y) GROUP BY 1",
        c="SELECT country_code, publication_year y, count(DISTINCT work_idx) k FROM fw GROUP BY 1, 2", n="SELECT publication_year y, count(DISTINCT work_idx) n FROM fw GROUP BY 1",
    ),
    "pivot_units": sql("SELECT unit_idx, " + ", ".join(f"round(max(v) FILTER (field_idx = {f}), 6) f{f}" for f in range(11, 37)) + ", round(sum(v), 6) total FROM rk WHERE unit_type = 'U' GROUP BY 1"),
    "country_benchmark": sql("SELECT country_code, count(*) n_units, round(100 * avg(CASE WHEN v >= 1 THEN 1.0::DOUBLE ELSE 0 END), 2) pct_ge_1, round(avg(v), 6) mean_v, round(median(v), 6) median_v, round(sum(v), 6) sum_v FROM rk JOIN inst ON unit_idx = institution_idx WHERE unit_type = 'U' GROUP BY 1"),
    "national_rank": sql("SELECT field_idx, unit_idx, country_code, v, rank() OVER (PARTITION BY field_idx, country_code ORDER BY round(v, 9) DESC NULLS LAST)::INT national_rank FROM rk JOIN inst ON unit_idx = institution_idx WHERE unit_type = 'U'"),
    "issn_title_match": sql(
        "SELECT * FROM one UNION ALL SELECT list_id, min(source_idx), 'title' FROM li JOIN src ON trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')) = trim(regexp_replace(lower(display_name), '[^a-z0-9]+', ' ', 'g')) WHERE list_id NOT IN (SELECT list_id FROM one) GROUP BY 1",
        sk="SELECT source_idx, unnest([lpad((source_idx // 7)::VARCHAR, 4, '0') || lpad((source_idx % 977)::VARCHAR, 4, '0'), lpad(((source_idx + 3) // 7)::VARCHAR, 4, '0') || lpad(((source_idx + 3) % 977)::VARCHAR, 4, '0')]) i FROM src",
        li="SELECT source_idx list_id, CASE WHEN source_idx % 10 = 0 THEN lpad(((source_idx + 1) // 7)::VARCHAR, 4, '0') || lpad(((source_idx + 1) % 977)::VARCHAR, 4, '0') END i, upper(replace(display_name, '#', ' - ')) title FROM src WHERE source_idx % 5 = 0",
        one="SELECT list_id, min(source_idx) source_idx, 'issn' match_method FROM li JOIN sk USING (i) GROUP BY 1",
    ),
    "person_profile": sql("SELECT author_idx, count(DISTINCT work_idx) n_works, count(DISTINCT CASE WHEN round(work_v, 9) >= 1 THEN work_idx END) n_hi, round(median(work_v), 9) median_v, round(coalesce(avg(mean_inst_v), 0), 9) mean_inst_v, string_agg(DISTINCT field_idx::VARCHAR, '; ' ORDER BY field_idx::VARCHAR) fields, round(count(DISTINCT CASE WHEN round(work_v, 9) >= 1 THEN work_idx END) / count(DISTINCT work_idx)::DOUBLE, 9) share_hi FROM wv JOIN (SELECT DISTINCT work_idx, author_idx FROM auth) USING (work_idx) GROUP BY 1"),
    "waterfall_match": sql(
        "SELECT person, candidate, min(s)::INT stage FROM m GROUP BY 1, 2, (s) QUALIFY s = min(s) OVER (PARTITION BY person)",
        kk=_KEYS,
        m=" UNION ALL ".join(f"SELECT p.id person, c.id candidate, {k} s FROM kk p JOIN kk c ON p.id % 2 = 0 AND c.id % 2 = 1 AND {on}" for k, on in enumerate(("p.f = c.f AND p.m = c.m AND p.l = c.l", "p.f = c.f AND p.l = c.l", "p.fi = c.fi AND p.m = c.m AND p.l = c.l", "p.fi = c.fi AND p.l = c.l"), 1)),
    ),
    "token_jaccard": sql("SELECT a.id id_a, b.id id_b, round(len(list_intersect(a.t, b.t)) / (len(a.t) + len(b.t) - len(list_intersect(a.t, b.t)))::DOUBLE, 9) jaccard FROM tk a JOIN tk b ON a.id % 2 = 0 AND b.id % 2 = 1 WHERE len(list_intersect(a.t, b.t)) >= 0.5 * (len(a.t) + len(b.t) - len(list_intersect(a.t, b.t)))", tk=_TOK),
    "spearman": """SELECT p_brand, count(*) n, round(corr(p_size, p_retailprice), 6) pearson, round(corr(rx, ry), 6) spearman FROM (SELECT *, rank() OVER (PARTITION BY p_brand ORDER BY p_size) + (count(*) OVER (PARTITION BY p_brand, p_size) - 1) / 2.0::DOUBLE rx,
  rank() OVER (PARTITION BY p_brand ORDER BY p_retailprice) + (count(*) OVER (PARTITION BY p_brand, p_retailprice) - 1) / 2.0::DOUBLE ry FROM part) GROUP BY 1""",
    "ols": """WITH s AS (SELECT covar_pop(l_quantity, l_quantity) a, covar_pop(l_quantity, l_discount) b, covar_pop(l_discount, l_discount) c, covar_pop(l_quantity, l_extendedprice) d, covar_pop(l_discount, l_extendedprice) e, avg(l_quantity) x, avg(l_discount) z, avg(l_extendedprice) y FROM lineitem),
  f AS (SELECT *, (d * c - e * b) / (a * c - b * b) q, (e * a - d * b) / (a * c - b * b) r FROM s) SELECT 'intercept' term, round(y - q * x - r * z, 4) coef FROM f UNION ALL SELECT 'l_quantity', round(q, 4) FROM f UNION ALL SELECT 'l_discount', round(r, 4) FROM f""",
    "auc_somers_d": """WITH r AS (SELECT (o_orderstatus = 'F')::INT y, rank() OVER (ORDER BY o_totalprice) + (count(*) OVER (PARTITION BY o_totalprice) - 1) / 2.0::DOUBLE r FROM orders),
  s AS (SELECT sum(y)::BIGINT p, sum(1 - y)::BIGINT n, sum(r) FILTER (y = 1) r FROM r) SELECT p n_pos, n n_neg, round((r - p * (p + 1) / 2) / (p * n), 6) auc, round(2 * ((r - p * (p + 1) / 2) / (p * n)) - 1, 6) somers_d FROM s""",
    "tfidf_terms": """WITH d AS (SELECT (p_size % 5)::BIGINT g, p_partkey doc, p_retailprice > 950 inside, list_filter(regexp_extract_all(lower(p_name || ' ' || p_type), '\\b\\w\\w+\\b'), lambda x: x <> 'small') w FROM part),
  t AS (SELECT g, doc, term, count(*) tf FROM (SELECT g, doc, unnest(w) term FROM d UNION ALL SELECT g, doc, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM d) GROUP BY ALL),
  n AS (SELECT g, count(*) n, count(*) FILTER (inside) ni, count(*) FILTER (NOT inside) no FROM d GROUP BY 1), f AS (SELECT g, term, count(*) df FROM t GROUP BY ALL),
  w AS (SELECT t.g, doc, term, (1 + ln(tf)) * (ln((1.0 + n) / (1.0 + df)) + 1) w FROM t JOIN f USING (g, term) JOIN n ON n.g = t.g WHERE df >= 2 AND df <= 0.95 * n),
  u AS (SELECT g, doc, term, w / sqrt(sum(w * w) OVER (PARTITION BY g, doc)) w FROM w),
  m AS (SELECT u.g, term, coalesce(sum(u.w) FILTER (inside), 0) / max(ni) a, coalesce(sum(u.w) FILTER (NOT inside), 0) / max(no) b FROM u JOIN d USING (doc) JOIN n ON n.g = u.g WHERE ni >= 10 AND no >= 10 GROUP BY ALL)
  SELECT g "group", term, round(a, 6) mean_enc, round(b, 6) mean_non, row_number() OVER (PARTITION BY g ORDER BY round(a / (b + 1e-9) * a, 9) DESC, term)::INT rank FROM m QUALIFY rank <= 5""",
}

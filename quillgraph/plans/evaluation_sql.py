"""The evaluation queries in DuckDB's SQL, written apart from the engine."""

from __future__ import annotations

from quillgraph.plans import oracle
from quillgraph.plans.oracle import _BI, _RANKED, _giant, sql

_LOG = "CASE WHEN v > 0 THEN log10(v) WHEN v IS NOT NULL THEN -3.0::DOUBLE END"
_Q = "CASE WHEN source_v >= 1 THEN '+' WHEN source_v < 1 THEN '-' END || CASE WHEN mean_citer_v >= 1 THEN '+' WHEN mean_citer_v < 1 THEN '-' END"
_PAIRS = (("++", "pp"), ("+-", "pm"), ("-+", "mp"), ("--", "mm"))

STEPS: dict[str, str] = {
    "rb_": "SELECT DISTINCT f.field_idx, work_idx, source_idx, publication_year, title, v source_v FROM fw f JOIN rk ON unit_type = 'S' AND rk.field_idx = f.field_idx AND unit_idx = source_idx WHERE publication_year BETWEEN 1996 AND 2000",
    "rc_": "SELECT work_idx, max(source_v) v FROM rb_ GROUP BY 1",
    "ic_": "SELECT d.field_idx, d.work_idx, count(*) n_intra, avg(c.v) mean_citer_v, count(*) FILTER (c.v > 1) n_citer_hi, count(*) FILTER (c.v < 1) n_citer_lo FROM cr JOIN rc_ c ON c.work_idx = citer_idx JOIN rb_ d ON d.work_idx = cited_idx GROUP BY 1, 2",
    "hw_": "SELECT * FROM (SELECT rb_.*, coalesce(n_intra, 0) n_intra, mean_citer_v, coalesce(n_citer_hi, 0) n_citer_hi, coalesce(n_citer_lo, 0) n_citer_lo, quantile_cont(coalesce(n_intra, 0), 0.9) OVER (PARTITION BY rb_.field_idx, publication_year) year_threshold FROM rb_ LEFT JOIN ic_ USING (field_idx, work_idx)) WHERE n_intra >= year_threshold",
    "mi_": "SELECT f.field_idx, f.work_idx, avg(v) mean_inst_v FROM hw_ f JOIN (SELECT DISTINCT work_idx, institution_idx FROM fw) i USING (work_idx) JOIN rk ON unit_type = 'U' AND rk.field_idx = f.field_idx AND unit_idx = institution_idx GROUP BY 1, 2",
    "hc_": "SELECT hw_.*, mean_inst_v, source_v - mean_inst_v gap FROM hw_ LEFT JOIN mi_ USING (field_idx, work_idx)",
    "em_": "SELECT field_idx, work_idx % 3 enclave, work_idx, source_idx FROM hc_ WHERE source_v < 1 AND mean_citer_v < 1",
    "ee_": "SELECT m.field_idx, m.enclave, citer_idx, cited_idx, EXISTS (FROM em_ o WHERE o.field_idx = m.field_idx AND o.enclave = m.enclave AND o.work_idx = citer_idx) own FROM cr JOIN em_ m ON m.work_idx = cited_idx",
    "hq_": f"SELECT field_idx, work_idx, {_Q} q FROM hc_",
    "eo_": "SELECT field_idx, enclave, q, count(*) k FROM (SELECT DISTINCT field_idx, enclave, citer_idx FROM ee_ WHERE NOT own) e JOIN hq_ USING (field_idx) WHERE hq_.work_idx = citer_idx GROUP BY ALL",
    "en_": "SELECT field_idx, enclave, work_idx FROM em_ UNION SELECT field_idx, enclave, citer_idx FROM ee_",
    # components: what each node reaches along edges of its network, either way
    "eu_": "SELECT field_idx, enclave, citer_idx a, cited_idx b FROM ee_ UNION SELECT field_idx, enclave, cited_idx, citer_idx FROM ee_",
    "reach": "SELECT field_idx, enclave, work_idx, work_idx FROM en_ UNION SELECT r.field_idx, r.enclave, r.node, e.b FROM reach r JOIN eu_ e ON e.field_idx = r.field_idx AND e.enclave = r.enclave AND e.a = r.got",
    "el_": "SELECT field_idx, enclave, node, min(got) label FROM reach GROUP BY ALL",
    "ec_": "SELECT field_idx, enclave, count(*) n_comp, max(k) lg_hcw FROM (SELECT l.field_idx, l.enclave, label, count(*) k FROM el_ l JOIN em_ m ON m.field_idx = l.field_idx AND m.enclave = l.enclave AND m.work_idx = node GROUP BY ALL) GROUP BY ALL",
    "tn_": "SELECT field_idx, work_idx, t topic_idx, CASE WHEN field_idx = 20 THEN CASE t WHEN 0 THEN 'none' WHEN 1 THEN 'odd' WHEN 2 THEN 'even' ELSE '' END ELSE '' END topic_name FROM (SELECT field_idx, work_idx, CASE WHEN field_idx = 20 THEN CASE work_idx % 5 WHEN 3 THEN 1 WHEN 4 THEN 2 ELSE work_idx % 5 END ELSE work_idx % 5 END t FROM hc_)",
    "mb_": "SELECT DISTINCT author_idx // 50 person_id, author_idx, work_idx FROM auth WHERE author_idx % 50 = 0",
    "mw_": f"""SELECT person_id, author_idx, f.work_idx, f.field_idx, f.publication_year, f.source_idx, institution_idx, wv.source_v, wv.mean_inst_v, work_v, hc_.mean_citer_v, n_intra, n_citer_hi, n_citer_lo, nullif(topic_name, '') enclave_name,
  CASE WHEN hc_.work_idx IS NOT NULL THEN {_Q.replace("source_v", "wv.source_v").replace("mean_citer_v", "hc_.mean_citer_v")} END hcw_quadrant
  FROM mb_ JOIN (SELECT DISTINCT work_idx, publication_year, source_idx, institution_idx, field_idx FROM fw) f USING (work_idx) LEFT JOIN wv ON wv.work_idx = f.work_idx AND wv.field_idx = f.field_idx LEFT JOIN hc_ ON hc_.work_idx = f.work_idx AND hc_.field_idx = f.field_idx
  LEFT JOIN (SELECT * FROM tn_ WHERE topic_name <> '') t ON t.work_idx = f.work_idx AND t.field_idx = f.field_idx""",
    "wt_": "SELECT DISTINCT c.work_idx, publication_year, cited_by_count, authors_count, institutions_distinct_count, score field_score, t.field_idx FROM (SELECT DISTINCT work_idx, publication_year, cited_by_count, authors_count, institutions_distinct_count FROM fw) c JOIN topic t ON t.work_idx = c.work_idx WHERE cited_by_count > 2002 - publication_year",
    "wf_": "SELECT work_idx, publication_year, cited_by_count, authors_count, institutions_distinct_count, field_idx, round(round(sum(s), 9), 3) field_share FROM (SELECT *, field_score / sum(field_score) OVER (PARTITION BY work_idx) s FROM wt_) GROUP BY ALL",
    "ch_": "SELECT work_idx, publication_year, cited_by_count, field_idx, field_share FROM (SELECT *, CASE field_idx WHEN 20 THEN quantile_cont(cited_by_count, 0.5) OVER w WHEN 31 THEN quantile_cont(cited_by_count, 0.75) OVER w ELSE quantile_cont(cited_by_count, 0.9) OVER w END t FROM wf_ WINDOW w AS (PARTITION BY field_idx, publication_year)) WHERE cited_by_count >= t",
    "ar_": "SELECT h.field_idx, a.author_idx, a.work_idx, s_name inst_name, n_name inst_country FROM auth a JOIN (SELECT DISTINCT work_idx, field_idx FROM ch_ WHERE publication_year BETWEEN 1996 AND 2000) h USING (work_idx) JOIN supplier ON s_suppkey = institution_idx JOIN nation ON s_nationkey = n_nationkey",
    "fa_": """SELECT row_number() OVER (ORDER BY field_idx, n_hcw DESC, author_idx) row_idx, field_idx, author_idx, n_hcw, inst_name, inst_country, p_name display_name, p_size::BIGINT h_index FROM (SELECT field_idx, author_idx, count(DISTINCT work_idx) n_hcw FROM ar_ GROUP BY 1, 2)
  JOIN (SELECT field_idx, author_idx, inst_name, inst_country FROM ar_ GROUP BY 1, 2, 3, 4 QUALIFY row_number() OVER (PARTITION BY field_idx, author_idx ORDER BY count(*) DESC, inst_name, inst_country) = 1) USING (field_idx, author_idx) JOIN part ON p_partkey = author_idx""",
    "th_": "SELECT field_idx, greatest(1, floor(quantile_cont(n_hcw, 0.9)))::BIGINT thresh FROM fa_ GROUP BY 1",
    "lw_": """SELECT a.author_idx, hc_.work_idx, hc_.field_idx, source_v, mean_citer_v FROM hc_ JOIN (SELECT DISTINCT work_idx, author_idx FROM auth WHERE work_idx IN (SELECT work_idx FROM ch_)) a ON a.work_idx = hc_.work_idx
  WHERE a.author_idx IN (SELECT author_idx FROM fa_) AND a.author_idx % 40 IN (SELECT author_idx % 40 FROM fa_ WHERE author_idx % 3 < 2) AND a.author_idx % 40 < 30""",
    "nm_": "SELECT p_partkey id, CASE WHEN p_partkey % 4 = 0 THEN substr(p_name, 1, 1) ELSE split_part(p_name, ' ', 1) END fst, CASE WHEN p_partkey % 3 = 0 THEN lower(substr(p_type, 1, 1)) END mid, split_part(p_name, ' ', 2) lst, p_brand affil, p_type category FROM part",
    "kn_": "SELECT DISTINCT fst || ' ' || lst display_name, id % 26 + 11 field_idx, fst, lst, substr(fst, 1, 1) ini FROM nm_ WHERE id % 2 = 1 AND id % 7 < 3",
    # stand-ins for two snapshots of scores
    "k0_": "SELECT field_idx g, unit_idx, unit_type, v, ((unit_idx * 3) % 17 + 1.5)::DOUBLE a_p FROM rk",
    "k2_": "SELECT field_idx g, unit_idx, unit_type, ((unit_idx * 7 + field_idx * 3 + (unit_idx * 2) % 5) % 20) / 10.0::DOUBLE v, ((unit_idx * 5) % 17 + 1.5)::DOUBLE a_p FROM rk",
    "r0_": "SELECT *, dense_rank() OVER (PARTITION BY g, unit_type ORDER BY v DESC)::INT rank_v FROM k0_",
    "r2_": "SELECT *, dense_rank() OVER (PARTITION BY g, unit_type ORDER BY v DESC)::INT rank_v FROM k2_",
    "i0_": "SELECT g div, unit_idx, v, rank_v, a_p FROM r0_ WHERE unit_type = 'U'",
    "i2_": "SELECT g div, unit_idx, v, rank_v, a_p FROM r2_ WHERE unit_type = 'U'",
    "rt_": "SELECT *, CASE WHEN (unit_idx + div) % 4 <> 0 THEN ((unit_idx * 3 + div) % 5 + 1)::INT END rating FROM i0_",
    "dg_": "SELECT div, 100.0::DOUBLE * n / (SELECT count(*) FROM supplier) - CASE WHEN div % 6 = 0 THEN 60 ELSE 0 END retained_pct, ((div * 7) % 20) / 40.0::DOUBLE gap, ((div * 13) % 60) / 10.0::DOUBLE pairs_per_work, n FROM (SELECT div, count(*) n FROM i0_ GROUP BY 1)",
    "fu_": "SELECT *, ((unit_idx * 5 + div) % 3 = 0)::INT seat, (rating <= 3)::INT low FROM rt_ WHERE rating IS NOT NULL",
    "sd_": "SELECT a.div, a.unit_idx, a.v v_old, b.v v_new, b.v - a.v delta_v, 100 * (b.v - a.v) / nullif(a.v, 0) pct_change_v, a.unit_idx % 4 mission FROM i0_ a JOIN i2_ b USING (div, unit_idx)",
}
oracle._RECURSIVE["reach"] = "(field_idx, enclave, node, got)"


def q(body: str, **more: str) -> str:
    return sql(body, **(STEPS | more))


def _r(*cols: str, to: int = 6) -> str:
    return ", ".join(f"round({c}, {to}) {c}" for c in cols)


_AVG = "(SELECT *, rank() OVER (PARTITION BY {k} ORDER BY {a}) + (count(*) OVER (PARTITION BY {k}, {a}) - 1) / 2.0::DOUBLE ra, rank() OVER (PARTITION BY {k} ORDER BY {b}) + (count(*) OVER (PARTITION BY {k}, {b}) - 1) / 2.0::DOUBLE rb, count(*) OVER (PARTITION BY {k}) n FROM {t})"
_TIER = "CASE WHEN v >= 1.4 THEN 5 WHEN v >= 1.1 THEN 4 WHEN v >= 0.8 THEN 3 WHEN v >= 0.5 THEN 2 ELSE 1 END"
_LABEL = "CASE " + _TIER + " WHEN 5 THEN 'Well above world standard' WHEN 4 THEN 'Above world standard' WHEN 3 THEN 'At world standard' WHEN 2 THEN 'Below world standard' ELSE 'Well below world standard' END"
_H = lambda *cols: "substr(sha256('[' || " + " || ', ' || ".join(f"'\"' || {c} || '\"'" for c in cols) + " || ']'), 1, 16)"
_CAP = lambda c: f"upper(substr({c}, 1, 1)) || substr({c}, 2)"
_RHO = {"ew": "SELECT *, edge_field_weight ew FROM el"}
_BETA = {"ew": "SELECT * FROM (SELECT *, CASE WHEN R_i = 0 THEN 0 ELSE edge_field_weight * (SELECT avg(R_i) FROM (SELECT DISTINCT citer_work_idx, R_i FROM el)) / R_i END ew FROM el) WHERE NOT (citer_source_idx = cited_source_idx AND citer_inst_idx = cited_inst_idx)"}
_OMEGA = {"ew": "SELECT * REPLACE (direct_inst_weight AS inst_weight, direct_cited_inst_weight AS cited_inst_weight), CASE WHEN R_i = 0 THEN 0 ELSE edge_field_weight * (SELECT avg(R_i) FROM (SELECT DISTINCT citer_work_idx, R_i FROM el)) / R_i END ew FROM el"}
_BLOC = "AND work_idx NOT IN (SELECT work_idx FROM fw WHERE leiden_idx = 4 AND publication_year BETWEEN 1996 AND 2000 AND country_code NOT IN (" + ", ".join(f"'NATION_{k}'" for k in range(20)) + "))"
_FI = oracle.W["fi"]


def _variant(steps: dict[str, str]) -> str:
    return sql(_RANKED, **_BI, **steps)


def _unit(group: int, members: str) -> str:
    """Candidates of a unit's subfields, whose scores sum to 1."""
    mine = f"FROM fw WHERE publication_year BETWEEN 1996 AND 2000 AND subfield_idx IN {members}"
    sources = f"SELECT source_idx FROM (SELECT DISTINCT work_idx, source_idx, subfield_idx, field_weight {mine}) GROUP BY 1 HAVING sum(field_weight) >= 0.25"
    institutions = f"SELECT institution_idx {mine} GROUP BY 1 HAVING sum(field_weight * inst_weight) >= 2.5"
    body = f"SELECT {group}::BIGINT group_idx, (SELECT count(*) FROM ({sources})) n_s_cands, (SELECT count(*) FROM ({institutions})) n_u_cands, 1.0::DOUBLE mass"
    return f"SELECT * FROM ({sql(body)})"


SQL: dict[str, str] = {
    "field_citations": q("SELECT d.field_idx, d.work_idx, count(*) n_intra FROM cr JOIN wv c ON c.work_idx = citer_idx JOIN wv d ON d.work_idx = cited_idx AND d.field_idx = c.field_idx GROUP BY 1, 2"),
    "hcw_assembly": q(f"SELECT field_idx, work_idx, publication_year, source_idx, n_intra, n_citer_hi, n_citer_lo, title, {_r('year_threshold', 'source_v', 'mean_citer_v', 'mean_inst_v', to=9)}, round(gap, 9) + 0.0::DOUBLE gap FROM hc_"),
    "hcw_summary": q("SELECT field_idx, count(*) n_hcw, round(median(source_v), 6) median_src_v, round(median(mean_citer_v), 6) median_citer_v, round(median(mean_inst_v), 6) median_inst_v, count(*) FILTER (source_v < 1 AND mean_citer_v < 1) n_enclave, count(*) FILTER (source_v < 1 AND mean_citer_v > 1) n_lo_hi, round(count(*) FILTER (source_v < 1 AND mean_citer_v < 1) / count(*)::DOUBLE, 6) enc_rate FROM hc_ GROUP BY 1"),
    "enclave_networks": q(
        "SELECT *, round(lg_hcw / n_hcw::DOUBLE, 6) lg_pct FROM (SELECT m.field_idx, m.enclave, count(*) n_hcw, coalesce((SELECT count(*) FROM ee_ e WHERE e.field_idx = m.field_idx AND e.enclave = m.enclave), 0) n_edges, coalesce((SELECT count(DISTINCT citer_idx) FROM ee_ e WHERE e.field_idx = m.field_idx AND e.enclave = m.enclave), 0) n_citers, "
        "round(coalesce((SELECT 100.0::DOUBLE * count(*) FILTER (own) / count(*) FROM ee_ e WHERE e.field_idx = m.field_idx AND e.enclave = m.enclave HAVING count(*) > 0), 0), 6) loop_pct, "
        + ", ".join(
            f"coalesce((SELECT k FROM eo_ o WHERE o.field_idx = m.field_idx AND o.enclave = m.enclave AND o.q = '{s}'), 0) n_{n}, round(coalesce(100.0::DOUBLE * (SELECT k FROM eo_ o WHERE o.field_idx = m.field_idx AND o.enclave = m.enclave AND o.q = '{s}') / (SELECT count(*) FROM hq_ h WHERE h.field_idx = m.field_idx AND h.q = '{s}'), 0), 6) pct_{n}"
            for s, n in _PAIRS if n != "mm"
        )
        + ", (SELECT round(avg(work_v), 6) FROM em_ e JOIN wv USING (field_idx, work_idx) WHERE e.field_idx = m.field_idx AND e.enclave = m.enclave) mean_wv_seeds, (SELECT round(avg(work_v), 6) FROM en_ e JOIN wv USING (field_idx, work_idx) WHERE e.field_idx = m.field_idx AND e.enclave = m.enclave) mean_wv_net, "
        "(SELECT n_comp FROM ec_ c WHERE c.field_idx = m.field_idx AND c.enclave = m.enclave) n_comp, (SELECT lg_hcw FROM ec_ c WHERE c.field_idx = m.field_idx AND c.enclave = m.enclave) lg_hcw FROM em_ m GROUP BY 1, 2)"
    ),
    "enclave_sources": q("SELECT field_idx, enclave, source_idx, count(*) n_works, row_number() OVER (PARTITION BY field_idx, enclave ORDER BY count(*) DESC, source_idx)::INT AS rank FROM em_ GROUP BY 1, 2, 3 QUALIFY rank <= 4"),
    "topic_naming": q("SELECT field_idx, work_idx, topic_idx, topic_name FROM tn_"),
    "member_works": q(f"SELECT * REPLACE ({', '.join(f'round({c}, 9) AS {c}' for c in ('source_v', 'mean_inst_v', 'work_v', 'mean_citer_v'))}, {', '.join(f'{c}::DOUBLE AS {c}' for c in ('n_intra', 'n_citer_hi', 'n_citer_lo'))}) FROM mw_"),
    "member_profiles": q(
        "SELECT person_id, count(DISTINCT work_idx) n_works_corpus, count(DISTINCT work_idx) FILTER (source_v IS NOT NULL) n_ranked_works, " + ", ".join(f"round(avg({c}), 6) avg_{c}" for c in ("source_v", "mean_inst_v", "work_v", "mean_citer_v")) + ", "
        + ", ".join(f"round(median({c}), 6) median_{c}" for c in ("source_v", "work_v", "mean_citer_v")) + ", coalesce(sum(n_citer_hi), 0)::BIGINT tot_citer_hi, coalesce(sum(n_citer_lo), 0)::BIGINT tot_citer_lo, round(sum(n_citer_hi)::DOUBLE / nullif(sum(n_citer_hi) + sum(n_citer_lo), 0), 6) high_citer_ratio, "
        + ", ".join(f"count(DISTINCT work_idx) FILTER (hcw_quadrant = '{s}') n_hcw_{n}" for s, n in _PAIRS) + ", count(DISTINCT work_idx) FILTER (hcw_quadrant IS NOT NULL) n_hcw_total, count(DISTINCT work_idx) FILTER (enclave_name IS NOT NULL) n_enclave_works, coalesce(string_agg(DISTINCT enclave_name, '; ' ORDER BY enclave_name), '') enclave_topics FROM mw_ GROUP BY 1"
    ),
    "works_by_topic": q("SELECT * FROM wt_"),
    "works_by_field": q("SELECT * FROM wf_"),
    "highly_cited_works": q("SELECT * FROM ch_"),
    "highly_cited_authors": q("SELECT * FROM fa_"),
    "highly_cited_authorships": q("SELECT DISTINCT work_idx, author_idx FROM auth WHERE work_idx IN (SELECT work_idx FROM ch_)"),
    "author_thresholds": q("SELECT * FROM th_"),
    "prolific_authors": q("SELECT author_idx, field_idx, n_hcw, display_name FROM fa_ JOIN th_ USING (field_idx) WHERE n_hcw >= thresh QUALIFY row_number() OVER (PARTITION BY author_idx ORDER BY n_hcw DESC, field_idx) = 1"),
    "listed_overlay": q(f"SELECT author_idx, work_idx, field_idx, {_r('source_v', 'mean_citer_v', to=9)} FROM lw_"),
    "pool_means": q("SELECT round(avg(lx), 6) pool_x, round(avg(ly), 6) pool_y, (SELECT round(avg(x), 6) FROM (SELECT avg(log10(source_v)) x FROM lw_ WHERE source_v > 0 AND mean_citer_v > 0 GROUP BY author_idx)) person_x, (SELECT round(avg(x), 6) FROM (SELECT avg(log10(mean_citer_v)) x FROM lw_ WHERE source_v > 0 AND mean_citer_v > 0 GROUP BY author_idx)) person_y FROM (SELECT log10(source_v) lx, log10(mean_citer_v) ly FROM lw_ WHERE source_v > 0 AND mean_citer_v > 0)"),
    "name_keys": q("SELECT id, lower(fst) first_norm, lower(lst) last_norm, lower(substr(fst, 1, 1)) initial FROM nm_"),
    "two_tier_match": q(
        "SELECT n.id person, CASE WHEN e.k > 0 THEN 'exact' WHEN i.k > 0 THEN 'initial' END tier, CASE WHEN e.k > 0 THEN 1 ELSE coalesce(i.d, 0) END::BIGINT n_ambiguous, (CASE WHEN e.k > 0 THEN e.k ELSE i.k END)::INT n_matches, CASE WHEN e.k > 0 THEN e.f ELSE i.f END first_match FROM nm_ n LEFT JOIN (SELECT fst, lst, count(*) k, min(display_name) f FROM kn_ GROUP BY 1, 2) e ON e.fst = n.fst AND e.lst = n.lst "
        "LEFT JOIN (SELECT ini, lst, count(*) k, count(DISTINCT display_name) d, min(display_name) f FROM kn_ GROUP BY 1, 2) i ON i.ini = substr(n.fst, 1, 1) AND i.lst = n.lst WHERE n.id % 2 = 0"
    ),
    "person_categories": q(
        f"SELECT {_H('f', 'l', 'affil')} person_hash, {_H('lst', 'ini')} cluster_hash, {_H(_H('lst', 'ini'), 'lower(affil)')} sub_cluster_hash, f first_name, l last_name, affil, string_agg(category, '; ' ORDER BY category) categories, count(*) n_categories, count(*) > 1 multi_category FROM (SELECT {_CAP('fst')} f, {_CAP('lst')} l, lst, substr(fst, 1, 1) ini, affil, category FROM nm_) GROUP BY f, l, lst, ini, affil"
    ),
    "unit_runs": " UNION ALL ".join(_unit(g, m) for g, m in ((1, "(16, 17, 18, 19)"), (2, "(18, 21, 24)"))),
    "clusters_table": q(
        f"""SELECT a.id author_idx, {_H('lst', 'substr(fst, 1, 1)')} cluster_hash, count(*) OVER (PARTITION BY lst, substr(fst, 1, 1)) cluster_n, {_CAP('fst')} || ' ' || {_CAP('lst')} display_name, lst last_norm, substr(fst, 1, 1) initial,
        m.n inst_name_modal, m.c inst_country_modal, r.n inst_name_recent, r.c inst_country_recent, 'name_only' cluster_status, {_CAP('fst')} first_part, {_CAP('lst')} last_part FROM nm_ a
        LEFT JOIN (SELECT author_idx, s_name n, n_name c FROM auth JOIN supplier ON s_suppkey = institution_idx JOIN nation ON n_nationkey = s_nationkey GROUP BY author_idx, s_name, n_name QUALIFY row_number() OVER (PARTITION BY author_idx ORDER BY count(*) DESC, s_name, n_name) = 1) m ON m.author_idx = a.id
        LEFT JOIN (SELECT author_idx, s_name n, n_name c FROM auth JOIN supplier ON s_suppkey = institution_idx JOIN nation ON n_nationkey = s_nationkey QUALIFY row_number() OVER (PARTITION BY author_idx ORDER BY work_idx DESC, institution_idx DESC) = 1) r ON r.author_idx = a.id"""
    ),
    "waterfall_institutions": q(
        "SELECT a.id person, coalesce(s, 0)::INT stage, CASE WHEN k = 1 THEN 1 ELSE coalesce(n, 0) END::BIGINT n_cands, CASE WHEN n IS NULL THEN 'zero' WHEN n = 1 THEN 'unique' WHEN k = 1 THEN 'inst_resolved' ELSE 'ambiguous' END match_status, coalesce(CASE WHEN n = 1 THEN o WHEN k = 1 THEN ft END, -1) candidate FROM nm_ a LEFT JOIN g_ ON g_.p = a.id WHERE a.id % 2 = 0",
        m_=" UNION ALL ".join(f"SELECT p.id p, c.id c, {k} s, contains(p.affil || ', Nowhere', c.affil) OR contains(c.affil, p.affil) fits FROM nm_ p JOIN nm_ c ON p.id % 2 = 0 AND c.id % 2 = 1 AND {on}" for k, on in enumerate(("p.fst = c.fst AND p.mid = c.mid AND p.lst = c.lst", "p.fst = c.fst AND p.lst = c.lst", "substr(p.fst, 1, 1) = substr(c.fst, 1, 1) AND p.mid = c.mid AND p.lst = c.lst", "substr(p.fst, 1, 1) = substr(c.fst, 1, 1) AND p.lst = c.lst"), 1)),
        g_="SELECT p, s, count(*) n, count(*) FILTER (fits) k, max(c) o, max(c) FILTER (fits) ft FROM m_ GROUP BY 1, 2 QUALIFY s = min(s) OVER (PARTITION BY p)",
    ),
    "cluster_scores": q("SELECT author_idx // 10 AS cluster, count(*) n_authors, count(n) n_found, coalesce(sum(n), 0)::BIGINT n_hcw, round(1 - count(n) / count(*)::DOUBLE, 6) miss_rate FROM (SELECT DISTINCT author_idx FROM auth) LEFT JOIN (SELECT author_idx, sum(n_hcw) n FROM fa_ GROUP BY 1) USING (author_idx) GROUP BY 1"),
    "affiliation_keywords": "SELECT p_partkey, CASE WHEN contains(lower(p_brand), 'brand#1') THEN 'One' WHEN contains(lower(p_brand), 'brand#2') THEN 'Two' WHEN contains(lower(p_brand), '#3') THEN 'Three' ELSE '' END keyword FROM part",
    "committee_authors": q(
        "SELECT id person_id, author_idx, ['exact_inst', 'inst_only', 'first_only', 'fallback_highest_cite'][t] match_status FROM nm_ LEFT JOIN (SELECT pid, author_idx, t FROM c_ QUALIFY row_number() OVER (PARTITION BY pid ORDER BY t, cites DESC, author_idx) = 1) ON pid = id WHERE id % 40 = 1",
        c_="SELECT r.id pid, p_partkey author_idx, floor(p_retailprice)::BIGINT cites, CASE WHEN fo AND io THEN 1 WHEN io THEN 2 WHEN fo THEN 3 ELSE 4 END t FROM (SELECT r.id, p_partkey, p_retailprice, split_part(p_name, ' ', 1) = r.fst fo, w <> '' AND contains(lower('dept of ' || CASE WHEN contains(p_brand, '#1') THEN 'One' ELSE p_type END), w) io FROM (SELECT id, fst, lst, lower(CASE WHEN contains(lower(affil), 'brand#1') THEN 'One' WHEN contains(lower(affil), 'brand#2') THEN 'Two' WHEN contains(lower(affil), '#3') THEN 'Three' ELSE '' END) w FROM nm_ WHERE id % 40 = 1) r JOIN part ON lower(split_part(p_name, ' ', -1)) = r.lst AND lower(substr(p_name, 1, 1)) = substr(r.fst, 1, 1) AND p_size > 0) r",
    ),
    "abstracts": "SELECT p_partkey, p_name abstract FROM part",
    "cite_keys": "SELECT p_partkey, regexp_replace(lower(split_part(p_name, ' ', -1)), '[^a-z]', '', 'g') || CASE WHEN p_size > 5 THEN (p_size + 1950)::VARCHAR ELSE 'nodate' END || regexp_replace(lower(split_part(p_type, ' ', 1)), '[^a-z]', '', 'g') cite_key FROM part",
    "cand_subfield": q("SELECT subfield_idx group_idx, source_idx, round(sum(field_weight), 9) weighted_works FROM (SELECT DISTINCT work_idx, source_idx, subfield_idx, field_weight FROM fw WHERE publication_year BETWEEN 1996 AND 2000) GROUP BY 1, 2"),
    "division_members": q("SELECT code[1:2] division, string_agg(lpad(subfield_idx::VARCHAR, 2, '0'), ',' ORDER BY lpad(subfield_idx::VARCHAR, 2, '0')) subfields, min(code) first_code FROM (SELECT DISTINCT subfield_idx, lpad((subfield_idx * 37 % 2200 + 100)::VARCHAR, 4, '0') code FROM topic) GROUP BY 1"),
    "rank_diagnostics": sql("SELECT (SELECT count(*) FROM gs WHERE weighted_works >= 0.25) n_s_cands, (SELECT count(*) FROM gu WHERE weighted_works >= 2.5) n_u_cands, (SELECT count(*) FROM scc WHERE node % 2 = 0) n_s_ranked, (SELECT count(*) FROM scc WHERE node % 2 = 1) n_u_ranked", **_giant("SELECT 2 * src src, 2 * dst + 1 dst, w FROM si UNION ALL SELECT 2 * src + 1, 2 * dst, w FROM iss")),
    "rank_rho1": _variant(_RHO),
    "rank_omega1": _variant(_OMEGA),
    "rank_beta1": _variant(_BETA),
    "rank_tau": _variant({"fi": _FI.replace(">= 0.25", ">= 0.5").replace(">= 2.5", ">= 5"), "us": oracle.W["us"].replace("0.25", "0.5"), "uu": oracle.W["uu"].replace("2.5", "5")}),
    "rank_bloc": _variant({"fi": _FI.replace("GROUP BY 1, 2, 3", f"{_BLOC} GROUP BY 1, 2, 3")}),
    "ranking_display": q("SELECT rank_v, r.unit_idx, s_name display_name, round(v, 3) v, round(v, 6) pi, round(a_p, 1) a_p FROM r0_ r LEFT JOIN supplier ON s_suppkey = r.unit_idx WHERE g = 20 AND unit_type = 'U' ORDER BY rank_v, r.unit_idx LIMIT 20"),
    "national_report": q("SELECT g group_idx, unit_idx, 'H' || unit_idx hep, v, v pi, rank_v rank_v_global, rank() OVER (PARTITION BY g ORDER BY round(v, 9) DESC)::INT rank_v_national, rank_v rank_pi_global, a_p FROM r0_ JOIN supplier ON s_suppkey = unit_idx JOIN nation ON n_nationkey = s_nationkey WHERE unit_type = 'U' AND n_name < 'NATION_2'"),
    "v_tiers": q(f"SELECT div, unit_idx, ({_TIER})::INT tier, {_LABEL} AS label FROM i0_"),
    "rating_codes": "SELECT 'H' || s_suppkey hep, CASE length(c) WHEN 1 THEN '0' || c WHEN 3 THEN '0' || c ELSE c END for_code, (s_suppkey % 8)::INT rating FROM (SELECT s_suppkey, (s_suppkey * 31 % 1300)::VARCHAR c FROM supplier) WHERE s_suppkey % 8 BETWEEN 1 AND 5",
    "division_indicators": q(
        "SELECT div, n_units, n_rated, round(median_3, 6) median_3, round(median_4, 6) median_4, round(median_5, 6) median_5, n_pos, n_neg, round(auc, 6) auc, round(retained_pct, 6) retained_pct, round(gap, 6) gap, round(pairs_per_work, 6) pairs_per_work, "
        "CASE WHEN retained_pct < 50 OR pairs_per_work < 0.2 OR n_units <= 2 THEN 'Collapsed (Non-viable)' WHEN gap < 0.1 OR n_units < 15 THEN 'Fragile / Low coverage' WHEN auc >= 0.75 AND abs(median_3) <= 0.15 THEN 'Highly Reliable' WHEN retained_pct >= 90 AND gap >= 0.2 THEN 'Structurally Sound' ELSE 'Moderate' END verdict FROM x_ JOIN dg_ USING (div) LEFT JOIN y_ USING (div)",
        l_=f"SELECT *, {_LOG} lv FROM rt_",
        x_="SELECT div, count(*) n_units, count(rating) n_rated, median(lv) FILTER (rating = 3) median_3, median(lv) FILTER (rating = 4) median_4, median(lv) FILTER (rating = 5) median_5 FROM l_ GROUP BY 1",
        y_="SELECT div, sum(h)::BIGINT n_pos, sum(1 - h)::BIGINT n_neg, CASE WHEN sum(h) >= 2 AND sum(1 - h) >= 2 THEN (sum(r) FILTER (h = 1) - sum(h) * (sum(h) + 1) / 2) / (sum(h) * sum(1 - h)) END auc FROM (SELECT div, (rating >= 4)::INT h, rank() OVER (PARTITION BY div ORDER BY v) + (count(*) OVER (PARTITION BY div, v) - 1) / 2.0::DOUBLE r FROM rt_ WHERE rating IS NOT NULL) GROUP BY 1",
    ),
    "supplement_roles": q("SELECT w work_idx, CASE WHEN bool_or(a) AND bool_or(NOT a) THEN 'both' WHEN bool_or(a) THEN 'cited' ELSE 'citer' END AS role FROM (SELECT cited_idx w, true a FROM refs WHERE citer_idx IN (SELECT work_idx FROM fw) UNION ALL SELECT citer_idx, false FROM refs WHERE cited_idx IN (SELECT work_idx FROM fw)) WHERE w NOT IN (SELECT work_idx FROM fw) GROUP BY 1"),
    "concat_key_join": "SELECT a.s_suppkey id, b.s_suppkey::VARCHAR ror_id, b.s_name AS name FROM supplier a JOIN supplier b ON 'https://ror.example/' || b.s_suppkey = 'https://ror.example/' || a.s_suppkey * 2",
    "first_of_group": q("SELECT author_idx, institution_idx first_inst, publication_year first_year FROM auth JOIN works USING (work_idx) QUALIFY row_number() OVER (PARTITION BY author_idx ORDER BY publication_year, work_idx, institution_idx) = 1"),
    "dashboard_row": q("SELECT (SELECT count(DISTINCT work_idx) FROM fw) n_works, (SELECT count(DISTINCT source_idx) FROM fw) n_sources, (SELECT count(DISTINCT institution_idx) FROM fw) n_inst, (SELECT count(DISTINCT country_code) FROM fw) n_countries, (SELECT count(*) FROM fw) n_rows, (SELECT count(*) FROM cr) n_refs, (SELECT count(DISTINCT citer_idx) FROM cr) n_citing"),
    "windowed_percentile": q("SELECT * FROM (SELECT work_idx, publication_year, cited_by_count, round(quantile_cont(cited_by_count, 0.9) OVER (PARTITION BY publication_year), 9) p90 FROM works) WHERE cited_by_count >= p90"),
    "percent_of_total": q("SELECT field_idx, count(*) n, round(100 * count(*) / sum(count(*)) OVER (), 6)::DOUBLE pct FROM fw GROUP BY 1"),
    "score_residuals": q("SELECT div, unit_idx, round(i + s * lv, 6) expected, round(rating - (i + s * lv), 6) residual, round(i + s * lv - rating, 6) deficit FROM l_, (SELECT regr_slope(rating, lv) s, regr_intercept(rating, lv) i FROM l_)", l_=f"SELECT *, {_LOG} lv FROM rt_"),
    "group_tests": q(
        "SELECT n_1, n_0, round(m1, 6) mean_1, round(m0, 6) mean_0, round((m1 - m0) / sqrt(((n_1 - 1) * v1 + (n_0 - 1) * v0) / (n_1 + n_0 - 2) * (1 / n_1::DOUBLE + 1 / n_0::DOUBLE)), 6) t, round(rs - n_1 * (n_1 + 1) / 2, 6) u FROM (SELECT count(*) FILTER (seat = 1) n_1, count(*) FILTER (seat = 0) n_0, avg(v) FILTER (seat = 1) m1, avg(v) FILTER (seat = 0) m0, var_samp(v) FILTER (seat = 1) v1, var_samp(v) FILTER (seat = 0) v0, sum(r) FILTER (seat = 1) rs FROM (SELECT *, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2.0::DOUBLE r FROM fu_))"
    ),
    "relative_risks": q("SELECT *, round(b / greatest(a, 0.001), 6) relative_risk, round(b - a, 6) excess, round(100 * (b - a) / greatest(b, 0.001), 6) attributable_pct, round(a, 6) rate_with, round(b, 6) rate_without FROM (SELECT 100 * avg(low) FILTER (seat = 1) a, 100 * avg(low) FILTER (seat = 0) b, count(*) FILTER (seat = 1 AND low = 0) n_10, count(*) FILTER (seat = 1 AND low = 1) n_11, count(*) FILTER (seat = 0 AND low = 0) n_00, count(*) FILTER (seat = 0 AND low = 1) n_01 FROM fu_ WHERE v >= 1)").replace("SELECT *, round(b /", "SELECT n_10, n_11, n_00, n_01, round(b /"),
    "percentile_shifts": q(f"SELECT div, unit_idx, round(ra / n, 6) pct_a, round(rb / n, 6) pct_b, round(rb / n - ra / n, 6) delta_pct FROM {_AVG.format(k='div', a='v', b='rating', t='fu_')}"),
    "quantile_tiers": q(
        "SELECT div, unit_idx, (SELECT count(*) + 1 FROM c_ WHERE cut < v)::INT cat FROM fu_",
        p_="SELECT rating, sum(count(*)) OVER (ORDER BY rating) / (SELECT count(*) FROM fu_)::DOUBLE p, row_number() OVER (ORDER BY rating DESC) d FROM fu_ GROUP BY 1",
        c_="SELECT l[1 + floor(h)::INT] + (l[1 + ceil(h)::INT] - l[1 + floor(h)::INT]) * (h - floor(h)) cut FROM (SELECT p * (len(l) - 1) h, l FROM p_, (SELECT list(v ORDER BY v) l FROM fu_) WHERE d > 1)",
    ),
    "snapshot_deltas": q(f"SELECT div, unit_idx, mission, {_r('v_old', 'v_new', 'delta_v', 'pct_change_v')} FROM sd_"),
    "deltas_by_mission": q("SELECT mission, count(*) n, round(avg(v_old), 6) mean_old, round(avg(v_new), 6) mean_new, round(avg(delta_v), 6) mean_delta, round(avg(pct_change_v), 6) pct_gain FROM sd_ GROUP BY 1"),
    "gainers_and_decliners": q("SELECT unit_idx, n_divs, round(mean_delta, 6) mean_delta, side FROM ((SELECT *, 'top' side FROM g_ ORDER BY round(mean_delta, 9) DESC, unit_idx LIMIT 5) UNION ALL (SELECT *, 'bottom' FROM g_ ORDER BY round(mean_delta, 9), unit_idx DESC LIMIT 5))", g_="SELECT unit_idx, count(*) n_divs, avg(delta_v) mean_delta FROM sd_ GROUP BY 1 HAVING count(*) >= 10"),
    "growth_by_division": q(
        "SELECT div, " + ", ".join(f"n_u_{x}, n_s_{x}, " + _r(*(f"{c}_{x}" for c in ("total", "ge1_u", "ge1_s", "mean_u", "mean_s"))) + f", round(n_u_{x} / nullif(n_s_{x}, 0)::DOUBLE, 6) ratio_{x}" for x in ("old", "new")) + ", " + ", ".join(f"round(100 * ({c}_new - {c}_old) / nullif({c}_old, 0)::DOUBLE, 6) growth_{c}" for c in ("n_u", "n_s", "mean_u", "mean_s", "total")) + " FROM o_ JOIN w_ USING (div)",
        **{n: f"SELECT g div, count(*) FILTER (unit_type = 'U') n_u_{x}, count(*) FILTER (unit_type = 'S') n_s_{x}, sum(a_p) FILTER (unit_type = 'U') total_{x}, " + ", ".join(f"100 * avg((v >= 1)::INT) FILTER (unit_type = '{t.upper()}') ge1_{t}_{x}, avg(a_p) FILTER (unit_type = '{t.upper()}') mean_{t}_{x}" for t in "us") + f" FROM {src} GROUP BY 1" for n, x, src in (("o_", "old", "k0_"), ("w_", "new", "k2_ WHERE unit_idx % 9 <> 0"))},
    ),
    "class_crosstab": q("SELECT subfield_idx // 4 division, subfield_idx // 4 >= 5 late, leiden_idx, count(*) n FROM (SELECT DISTINCT subfield_idx, leiden_idx FROM fw) GROUP BY 1, 2, 3"),
    "facet_rows": q(f"SELECT p.div::VARCHAR panel, unit_idx, p.rank_v rank_panel, b.rank_v rank_base, round(p.v, 6) v, round({_LOG.replace('v >', 'p.v >').replace('(v)', '(p.v)').replace('WHEN v', 'WHEN p.v')}, 6) log_v FROM i0_ p JOIN (SELECT unit_idx, rank_v FROM i0_ WHERE div = 20) b USING (unit_idx)".replace("p.p.v", "p.v")),
    "variant_changes": q("SELECT unit_idx, unit_type, a.rank_v rank_base, b.rank_v rank_var, round(a.v, 6) v_base, round(b.v, 6) v_var, round(la, 6) log_base, round(lb, 6) log_var, round(b.v - a.v, 6) delta_v, round(lb - la, 6) delta_log, a.rank_v - b.rank_v delta_rank FROM (SELECT *, CASE WHEN v > 0 THEN log10(v) ELSE -3.0::DOUBLE END la FROM r0_ WHERE g = 20) a JOIN (SELECT *, CASE WHEN v > 0 THEN log10(v) ELSE -3.0::DOUBLE END lb FROM r2_ WHERE g = 20) b USING (unit_idx, unit_type)"),
    "heat_rescale": q("SELECT div, unit_idx, round(v, 6) v, round(greatest(0, least(1, CASE WHEN v <= 1 THEN 0.5::DOUBLE * (v - lo) / greatest(1 - lo, 1e-9) ELSE 0.5::DOUBLE + 0.5::DOUBLE * (v - 1) / greatest(hi - 1, 1e-9) END)), 6) scaled FROM (SELECT *, min(v) OVER (PARTITION BY div) lo, max(v) OVER (PARTITION BY div) hi FROM i0_)"),
    "snapshot_diagnostics": q("SELECT div area, 2 * n n_s_old, n n_u_old, round(gap, 6) gap_old, 2 * n + 3 * div n_s_new, n + 3 n_u_new, round(((div * 7 + 3) % 20) / 40.0::DOUBLE, 6) gap_new, round(100 * 3 * div / (2 * n)::DOUBLE, 6) pct_s, round(300 / n::DOUBLE, 6) pct_u, round(((div * 7 + 3) % 20) / 40.0::DOUBLE - gap, 6) delta_gap FROM dg_"),
    "institution_means": q(
        "SELECT unit_idx, round(a, 6) mean_old, round(b, 6) mean_new, round(b - a, 6) delta_mean, floor(ra)::INT rank_old, floor(rb)::INT rank_new, floor(ra)::INT - floor(rb)::INT delta_rank FROM (SELECT *, rank() OVER (ORDER BY round(a, 9) DESC) + (count(*) OVER (PARTITION BY round(a, 9)) - 1) / 2.0::DOUBLE ra, rank() OVER (ORDER BY round(b, 9) DESC) + (count(*) OVER (PARTITION BY round(b, 9)) - 1) / 2.0::DOUBLE rb FROM (SELECT unit_idx, avg(v) a FROM i0_ GROUP BY 1) JOIN (SELECT unit_idx, avg(v) b FROM i2_ GROUP BY 1) USING (unit_idx))"
    ),
    "area_correlations": q(f"SELECT div, count(*) n, round(corr(v_old, v_new), 6) pearson, round(corr(ra, rb), 6) spearman FROM {_AVG.format(k='div', a='v_old', b='v_new', t='sd_').replace('count(*) OVER (PARTITION BY div) n', 'mission m_')} GROUP BY 1"),
    "committee_units": q(f"SELECT div, 'H' || unit_idx hep, round(v, 6) v, round({_LOG}, 6) log_v, rating, CASE WHEN unit_idx % 6 = 0 AND div % 2 = 0 THEN unit_idx % 2 + 1 ELSE 0 END::BIGINT n_seats, (unit_idx % 6 = 0 AND div % 2 = 0)::INT has_seat, (unit_idx IN (3, 6, 9))::INT in_group FROM rt_ WHERE rating IS NOT NULL AND unit_idx % 3 = 0"),
}

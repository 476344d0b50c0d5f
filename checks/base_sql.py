"""The derived tables as SQL common table expressions, in long form (one row per member)."""

BASE = r"""
ped AS (
  SELECT 'F' || (c_custkey // 4) AS family_id, 'P' || c_custkey AS person_id,
    (c_custkey % 4)::INT AS idx,
    CASE WHEN c_custkey % 4 >= 2 THEN 'P' || (c_custkey // 4 * 4) END AS mom_id,
    CASE WHEN c_custkey % 4 >= 2 THEN 'P' || (c_custkey // 4 * 4 + 1) END AS dad_id,
    CASE WHEN c_custkey % 4 = 0 THEN 2 WHEN c_custkey % 4 = 1 THEN 1
         WHEN c_custkey % 4 = 3 AND c_mktsegment = 'HOUSEHOLD' THEN 4
         ELSE 1 + c_nationkey % 2 END AS sex,
    CASE WHEN c_custkey % 4 = 2 THEN 2 WHEN c_custkey % 4 = 3 AND c_nationkey % 5 = 0 THEN 2
         WHEN c_custkey % 4 = 0 AND c_mktsegment = 'MACHINERY' THEN 4 ELSE 1 END AS status,
    CASE c_custkey % 4 WHEN 0 THEN 16 WHEN 1 THEN 32 WHEN 2 THEN 128 ELSE 256 END AS role,
    c_acctbal < -900 AS missing, c_mktsegment AS segment, c_nationkey AS nation, c_acctbal AS balance
  FROM customer),
members AS (
  SELECT p.*, m.person_id IS NOT NULL AS has_mom, d.person_id IS NOT NULL AS has_dad,
    m.person_id IS NOT NULL AND d.person_id IS NOT NULL AS is_child,
    m.person_id IS NULL AND d.person_id IS NULL AS is_founder
  FROM ped p
  LEFT JOIN (SELECT person_id FROM ped WHERE NOT missing) m ON p.mom_id = m.person_id
  LEFT JOIN (SELECT person_id FROM ped WHERE NOT missing) d ON p.dad_id = d.person_id
  WHERE NOT p.missing),
sites0 AS (
  SELECT p_partkey::INT AS s,
    CASE WHEN p_partkey % 5 = 4 THEN 'chrX' ELSE 'chr' || (1 + p_partkey % 5) END AS chromosome,
    (1 + p_partkey * 100)::INT AS position, p_size AS size, p_size % 10 = 7 AS cnv,
    CASE WHEN p_size % 10 = 7 THEN NULL WHEN p_size % 10 = 5 THEN 'ACACAC'
         WHEN p_size % 4 IN (0, 1) THEN 'A' ELSE 'ACT' END AS reference,
    CASE WHEN p_size % 10 = 7 THEN NULL WHEN p_size % 10 = 5 THEN 'ACACACAC'
         WHEN p_size % 4 = 0 THEN 'C' WHEN p_size % 4 = 1 THEN 'AGT' WHEN p_size % 4 = 2 THEN 'A'
         ELSE 'GG' END AS alt1,
    CASE WHEN p_size % 10 <> 7 AND p_size % 3 = 0 THEN 2 ELSE 1 END AS n_alts,
    p_size % 9 = 0 AS rare, p_brand AS gene,
    CASE p_type WHEN 'STANDARD' THEN 'missense' WHEN 'PROMO' THEN 'synonymous' WHEN 'SMALL' THEN 'nonsense'
      WHEN 'MEDIUM' THEN 'frame-shift' WHEN 'ECONOMY' THEN 'splice-site' WHEN 'LARGE' THEN 'intergenic' END AS effect,
    CASE WHEN p_size % 5 = 0 THEN 'Brand#' || (1 + p_size % 25) END AS gene2,
    CASE WHEN p_size % 7 <> 0 THEN p_retailprice END AS score,
    CASE WHEN p_size % 6 <> 0 THEN p_name END AS label
  FROM part),
sites AS (
  SELECT *, CASE WHEN cnv THEN position + size * 100 ELSE position + length(reference) - 1 END AS end_position
  FROM sites0),
alleles0 AS (
  SELECT s.*, ai.ai, CASE WHEN ai.ai = 2 THEN alt1 || 'T' ELSE alt1 END AS alternative,
    CASE WHEN n_alts = 2 THEN alt1 || ',' || alt1 || 'T' ELSE alt1 END AS site_alternative
  FROM sites s JOIN (SELECT 1 AS ai UNION ALL SELECT 2) ai ON ai.ai <= s.n_alts),
sa AS (
  SELECT *,
    CASE WHEN cnv THEN CASE WHEN size > 25 THEN 32 ELSE 16 END
      WHEN reference = 'ACACAC' AND ai = 1 THEN 2
      WHEN reference = 'ACACAC' AND ai = 2 THEN 2
      WHEN size % 4 = 0 THEN CASE ai WHEN 1 THEN 1 ELSE 8 END
      WHEN size % 4 = 1 THEN 2
      WHEN size % 4 = 2 THEN CASE ai WHEN 1 THEN 4 ELSE 4 END
      ELSE 8 END AS variant_type,
    CASE WHEN cnv THEN CASE WHEN size > 25 THEN 'CNV+' ELSE 'CNV-' END
      WHEN reference = 'ACACAC' AND ai = 1 THEN 'ins(AC)'
      WHEN reference = 'ACACAC' AND ai = 2 THEN 'ins(ACT)'
      WHEN size % 4 = 0 THEN CASE ai WHEN 1 THEN 'sub(A->C)' ELSE 'comp(A->CT)' END
      WHEN size % 4 = 1 THEN CASE ai WHEN 1 THEN 'ins(GT)' ELSE 'ins(GTT)' END
      WHEN size % 4 = 2 THEN CASE ai WHEN 1 THEN 'del(2)' ELSE 'del(1)' END
      ELSE CASE ai WHEN 1 THEN 'comp(ACT->GG)' ELSE 'comp(AC->GG)' END END AS variant,
    CASE WHEN cnv THEN chromosome || ':' || position || '-' || end_position
      ELSE chromosome || ':' || position END AS location,
    (1000000000::BIGINT + s) * 10000 + ai AS sj_index
  FROM alleles0),
first_call AS (
  SELECT 'F' || (o_custkey // 4) AS family_id, l_partkey::INT AS s,
    min(struct_pack(a := l_orderkey, b := l_linenumber, c := l_quantity, d := l_returnflag)) AS w
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2),
gt AS (
  SELECT f.family_id, f.s, w.d AS flag, m.person_id, m.idx, m.sex, m.status, m.role, m.mom_id, m.dad_id, m.is_child,
    m.is_founder, t.n_alts, t.chromosome, t.position,
    CASE WHEN (w.c::INT + m.idx) % 17 = 0 THEN -1
         WHEN t.rare AND w.c < 47 THEN 0
         WHEN (w.c::INT + m.idx) % 3 = 0 THEN 1 + (w.c::INT + w.b) % t.n_alts ELSE 0 END AS a1,
    CASE WHEN t.chromosome = 'chrX' AND NOT t.position BETWEEN 1 AND 40000 AND m.sex IN (1, 4) THEN -2
         WHEN (w.c::INT + m.idx) % 17 = 0 THEN -1
         WHEN t.rare AND w.c < 47 THEN 0
         WHEN (w.c::INT + w.b + 2 * m.idx) % 4 = 0 THEN 1 + (w.c::INT + m.idx) % t.n_alts ELSE 0 END AS a2
  FROM first_call f JOIN members m USING (family_id) JOIN sites t ON t.s = f.s),
fv AS (
  SELECT family_id, s, bool_and(a1 = 0 AND a2 = 0) AS all_ref, bool_or(a1 = -1 OR a2 = -1) AS any_unk,
    bool_and(a1 = -1 AND a2 = -1) AS all_unk FROM gt GROUP BY 1, 2),
present AS (
  SELECT DISTINCT family_id, s, ai FROM (
    SELECT family_id, s, a1 AS ai FROM gt WHERE a1 > 0 UNION ALL SELECT family_id, s, a2 FROM gt WHERE a2 > 0)),
member_class0 AS (
  SELECT c.family_id, c.s, ai.ai, c.person_id, c.idx, c.sex, c.status, c.role, c.flag, c.is_child, c.a1, c.a2,
    c.a1 = ai.ai OR c.a2 = ai.ai AS carrier,
    CASE WHEN m.person_id IS NULL OR d.person_id IS NULL THEN 256
      WHEN c.a1 = -1 OR c.a2 = -1 OR m.a1 = -1 OR m.a2 = -1 OR d.a1 = -1 OR d.a2 = -1 THEN 256
      WHEN c.a1 = ai.ai OR c.a2 = ai.ai THEN
        CASE WHEN m.a1 = ai.ai OR m.a2 = ai.ai OR d.a1 = ai.ai OR d.a2 = ai.ai THEN 2 ELSE 4 END
      WHEN (m.a1 = ai.ai AND m.a2 = ai.ai) OR (d.a1 = ai.ai AND d.a2 = ai.ai) THEN 16
      ELSE 128 END AS inh
  FROM gt c JOIN (SELECT 0 AS ai UNION ALL SELECT 1 UNION ALL SELECT 2) ai ON ai.ai <= c.n_alts
  LEFT JOIN gt m ON m.family_id = c.family_id AND m.s = c.s AND m.person_id = c.mom_id
  LEFT JOIN gt d ON d.family_id = c.family_id AND d.s = c.s AND d.person_id = c.dad_id),
fa_keys AS (
  SELECT p.family_id, p.s, p.ai FROM present p
  UNION ALL
  SELECT v.family_id, v.s, 0 FROM fv v
  WHERE NOT v.all_ref AND (v.any_unk OR EXISTS (
    SELECT 1 FROM member_class0 r WHERE r.family_id = v.family_id AND r.s = v.s AND r.ai = 0 AND r.inh = 4))),
member_class AS (SELECT mc.* FROM member_class0 mc JOIN fa_keys USING (family_id, s, ai)),
fa AS (
  SELECT family_id, s, ai, min(flag) AS flag,
    coalesce(bit_or(role) FILTER (WHERE carrier), 0) AS roles, coalesce(bit_or(sex) FILTER (WHERE carrier), 0) AS sexes,
    coalesce(bit_or(status) FILTER (WHERE carrier), 0) AS statuses, bit_or(inh) AS inheritance,
    coalesce(bit_or((CASE WHEN a1 = a2 THEN 1 ELSE 2 END)::BIGINT << (2 * CASE role WHEN 16 THEN 4 WHEN 32 THEN 5 WHEN 128 THEN 7 ELSE 8 END)) FILTER (WHERE carrier), 0) AS zroles,
    coalesce(bit_or((CASE WHEN a1 = a2 THEN 1 ELSE 2 END)::BIGINT << (2 * CASE sex WHEN 1 THEN 0 WHEN 2 THEN 1 ELSE 2 END)) FILTER (WHERE carrier), 0) AS zsexes,
    coalesce(bit_or((CASE WHEN a1 = a2 THEN 1 ELSE 2 END)::BIGINT << (2 * CASE status WHEN 1 THEN 0 WHEN 2 THEN 1 ELSE 2 END)) FILTER (WHERE carrier AND status <> 4), 0) AS zstatus,
    coalesce(string_agg(person_id, ';' ORDER BY idx) FILTER (WHERE carrier), '') AS carriers,
    count(*) FILTER (WHERE carrier) AS n_carriers,
    bool_and(a1 = -1 AND a2 = -1) AS all_unk
  FROM member_class GROUP BY 1, 2, 3),
v AS (
  SELECT f.*, a.chromosome, a.position, a.end_position, a.reference, a.alternative, a.site_alternative, a.gene, a.effect, a.gene2,
    a.score, a.label, a.variant_type, a.variant, a.location, a.cnv,
    f.family_id || '.' || a.location || '.' || coalesce(a.reference, 'None') || '.' || coalesce(a.site_alternative, 'None') AS fvuid
  FROM fa f JOIN sa a ON a.s = f.s AND a.ai = f.ai WHERE NOT f.all_unk),
called AS (
  SELECT s, count(*) AS called FROM gt g WHERE is_founder
    AND NOT EXISTS (SELECT 1 FROM fv u WHERE u.family_id = g.family_id AND u.s = g.s AND u.any_unk) GROUP BY 1),
copies AS (
  SELECT s, ai, count(*) AS n FROM (
    SELECT g.s, g.family_id, unnest([g.a1, g.a2]) AS ai FROM gt g WHERE is_founder) x
  WHERE ai >= 0 AND NOT EXISTS (SELECT 1 FROM fv u WHERE u.family_id = x.family_id AND u.s = x.s AND u.any_unk)
  GROUP BY 1, 2),
n_founders AS (SELECT count(*) AS founders FROM members WHERE is_founder),
freq AS (
  SELECT a.s, a.ai, coalesce(c.called, 0)::BIGINT AS af_parents_called_count,
    coalesce(100.0::DOUBLE * c.called / (SELECT founders FROM n_founders), 0) AS af_parents_called_percent,
    coalesce(k.n, 0)::BIGINT AS af_allele_count,
    CASE WHEN coalesce(c.called, 0) > 0 THEN 100.0::DOUBLE * coalesce(k.n, 0) / (2.0::DOUBLE * c.called) ELSE 0 END AS af_allele_freq,
    coalesce(r.n, 0)::BIGINT AS af_ref_allele_count,
    CASE WHEN coalesce(c.called, 0) > 0 THEN 100.0::DOUBLE * coalesce(r.n, 0) / (2.0::DOUBLE * c.called) ELSE 0 END AS af_ref_allele_freq
  FROM sa a LEFT JOIN called c ON c.s = a.s LEFT JOIN copies k ON k.s = a.s AND k.ai = a.ai
  LEFT JOIN copies r ON r.s = a.s AND r.ai = 0),
counters AS (
  SELECT s, ai, bit_or(statuses)::BIGINT AS seen_in_status, bool_or((inheritance & 4) <> 0) AS seen_as_denovo,
    count(*) AS family_variants_count FROM fa GROUP BY 1, 2),
summary AS (
  SELECT a.*, coalesce(c.seen_in_status, 0) AS seen_in_status, coalesce(c.seen_as_denovo, false) AS seen_as_denovo,
    coalesce(c.family_variants_count, 0) AS family_variants_count
  FROM sa a LEFT JOIN counters c ON c.s = a.s AND c.ai = a.ai
  WHERE a.s IN (SELECT s FROM counters))
"""


def sql(body: str) -> str:
    return f"WITH {BASE.strip()}\n{body.strip()}"

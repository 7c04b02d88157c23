"""Reference SQL views (DuckDB dialect) that the queries' reference statements share."""

from __future__ import annotations

from cohortlab.sources.fixtures import MODALITY_EVIDENCE, SOURCES

SCORES = [f"target_disease__{t}__{s}" for t, s in SOURCES]
PHASES = [f"target_disease__clinical__{p}__reached" for p in ("phase_max", "phase1", "phase2", "phase3", "phase4")]
ENTITY = ["target__clinical__phase_max__reached", "disease__clinical__phase_max__reached"]
TARGET_STATIC = [
    "target__tissue_specificity", "target__tissue_distribution",
    "target__genetic_constraint", "target__mouse_ko_score",
]
PAIR_FEATURES = [*PHASES, *SCORES]
ALL_FEATURES = [*PAIR_FEATURES, *ENTITY]


def clamp(year: str) -> str:
    return f"CASE WHEN {year} < 1996 THEN 1995 WHEN {year} > 2000 THEN 2001 ELSE {year} END"


def listing(names, template: str = "{0}") -> str:
    return ", ".join(template.format(n) for n in names)


def r6(expr: str, name: str) -> str:
    return f"round({expr}, 6) + 0.0 AS {name}"


def exact(expr: str, name: str) -> str:
    return f"({expr})::DOUBLE AS {name}"


_PHASE_COLUMNS = ["clinicalPhaseMaxReached", *[f"clinicalPhase{p}Reached" for p in (1, 2, 3, 4)]]
_CURATED = "'genomics_england','orphanet','gene2phenotype','uniprot_literature','uniprot_variants','clingen','eva'"
_NAMES = "CASE " + " ".join(
    f"WHEN modality='{m}' THEN list_extract({names!r}, p_size % {len(names)} + 1)"
    for m, names in MODALITY_EVIDENCE.items()
) + " END"

VIEWS: dict[str, str] = {}

VIEWS["v_evidence"] = """
SELECT 'T'||l_partkey AS "targetId",
  CASE WHEN l_orderkey%10=0 THEN 'A'||n_regionkey ELSE 'D'||n_nationkey END AS "diseaseId",
  CASE WHEN l_linestatus='F' THEN 'known_drug' WHEN l_returnflag='A' THEN 'genetic_association'
       WHEN l_returnflag='R' THEN 'literature' ELSE 'animal_model' END AS "datatypeId",
  CASE WHEN l_linestatus='F' THEN 'chembl' WHEN l_returnflag='R' THEN 'europepmc'
       WHEN l_returnflag<>'A' THEN 'impc'
       ELSE CASE o_orderpriority WHEN '1-URGENT' THEN 'eva' WHEN '2-HIGH' THEN 'orphanet'
            WHEN '5-LOW' THEN 'ot_genetics_portal' WHEN '4-NOT SPECIFIED' THEN 'gene_burden'
            ELSE 'clingen' END END AS "datasourceId",
  round(l_discount*10,1) AS score,
  CASE WHEN l_orderkey%3=0 THEN NULL ELSE [CAST(l_orderkey AS VARCHAR)] END AS literature,
  CASE WHEN l_orderkey%2=0 THEN CAST(year(l_shipdate) AS INT) END AS "publicationYear",
  CASE WHEN l_linestatus='F' THEN (CASE WHEN l_linenumber<=4 THEN l_linenumber ELSE 1 END)::DOUBLE END AS "clinicalPhase",
  CASE WHEN l_linestatus='F' THEN CAST(l_shipdate AS DATE) END AS "studyStartDate"
FROM lineitem JOIN orders ON l_orderkey=o_orderkey
  JOIN customer ON o_custkey=c_custkey JOIN nation ON c_nationkey=n_nationkey"""

VIEWS["v_targets"] = f"""
SELECT 'T'||p_partkey AS id, p_name AS "approvedSymbol", p_partkey, p_retailprice, p_size, modality,
  {_NAMES} AS evidence, p_partkey%3<>0 AS value
FROM (SELECT *, list_extract(['SM','AB','PR','OC'], p_partkey%4+1) AS modality FROM part)"""

VIEWS["v_prioritisation"] = """
SELECT 'T'||p_partkey AS "targetId", p_size/50.0::DOUBLE AS "tissueSpecificity",
  (p_retailprice-900)/100 AS "tissueDistribution",
  CASE WHEN p_partkey%7<>0 THEN p_size/100.0::DOUBLE END AS "geneticConstraint",
  CASE WHEN p_partkey%5<>0 THEN (p_partkey%10)/10.0::DOUBLE END AS "mouseKOScore"
FROM part"""

VIEWS["v_diseases"] = """
SELECT 'D'||n_nationkey AS id, n_name AS name, ['A'||n_regionkey] AS ancestors,
  ['A'||n_regionkey] AS areas, FALSE AS is_area FROM nation
UNION ALL
SELECT 'A'||r_regionkey, r_name, CAST([] AS VARCHAR[]), ['A'||r_regionkey], TRUE FROM region"""

VIEWS["v_areas"] = """
SELECT d.id AS disease_id, a.id AS therapeutic_area_id, a.name AS therapeutic_area_name
FROM (SELECT id, unnest(areas) AS area FROM v_diseases) d JOIN v_diseases a ON a.id=d.area AND a.is_area
UNION ALL
SELECT DISTINCT d.id, 'ALL_0', 'all'
FROM (SELECT id, unnest(areas) AS area FROM v_diseases) d JOIN v_diseases a ON a.id=d.area AND a.is_area"""

VIEWS["v_stages"] = f"""
SELECT "targetId", "diseaseId", CAST({clamp('y')} AS INT) AS year,
  CAST(floor(max("clinicalPhase")) AS INT) AS "clinicalPhaseMaxReached",
  max(CASE WHEN "clinicalPhase"=1 THEN 1 END) AS "clinicalPhase1Reached",
  max(CASE WHEN "clinicalPhase"=2 THEN 1 END) AS "clinicalPhase2Reached",
  max(CASE WHEN "clinicalPhase"=3 THEN 1 END) AS "clinicalPhase3Reached",
  max(CASE WHEN "clinicalPhase"=4 THEN 1 END) AS "clinicalPhase4Reached"
FROM (SELECT *, year("studyStartDate") AS y FROM v_evidence
      WHERE "datasourceId"='chembl' AND "clinicalPhase">=1 AND "studyStartDate" IS NOT NULL)
GROUP BY 1,2,3"""

VIEWS["v_augmented"] = f"""
SELECT * FROM v_evidence
UNION ALL
SELECT * REPLACE ('omim' AS "datasourceId") FROM v_evidence
WHERE "datatypeId"='genetic_association' AND "datasourceId"='eva' AND len(literature)>0
UNION ALL
SELECT * REPLACE ('curated' AS "datasourceId") FROM v_evidence
WHERE "datatypeId"='genetic_association' AND "datasourceId" IN ({_CURATED})"""

VIEWS["v_temporalized"] = f"""
SELECT "datatypeId","datasourceId","targetId","diseaseId", CAST({clamp('y')} AS INT) AS year, max(score) AS score
FROM (
  SELECT "datatypeId","datasourceId","targetId","diseaseId",score,year(o_orderdate) AS y
  FROM (SELECT *, TRY_CAST(unnest(literature) AS BIGINT) AS pmid FROM v_augmented) e
  JOIN orders ON o_orderkey=pmid
  UNION ALL
  SELECT "datatypeId","datasourceId","targetId","diseaseId",score,"publicationYear"
  FROM v_augmented WHERE "publicationYear" IS NOT NULL)
GROUP BY 1,2,3,4,5
UNION ALL
SELECT "datatypeId","datasourceId","targetId","diseaseId",CAST(NULL AS INT),max(score)
FROM v_augmented GROUP BY 1,2,3,4"""

VIEWS["v_pivot"] = (
    'SELECT "targetId" AS target_id, "diseaseId" AS disease_id, year, '
    + ", ".join(
        f"max(CASE WHEN \"datatypeId\"='{t}' AND \"datasourceId\"='{s}' THEN score END) AS target_disease__{t}__{s}"
        for t, s in SOURCES
    )
    + " FROM v_temporalized GROUP BY 1,2,3"
)

VIEWS["v_own"] = f"""
SELECT coalesce(s."targetId", p.target_id) AS target_id, coalesce(s."diseaseId", p.disease_id) AS disease_id,
  coalesce(s.year, p.year) AS year,
  {', '.join(f's."{a}" AS {b}' for a, b in zip(_PHASE_COLUMNS, PHASES))}, {listing(SCORES, 'p.{0}')}
FROM v_stages s FULL JOIN v_pivot p
  ON s."targetId"=p.target_id AND s."diseaseId"=p.disease_id AND s.year IS NOT DISTINCT FROM p.year"""

VIEWS["v_temporal"] = f"""
SELECT target_id, disease_id, year, {listing(ALL_FEATURES, 'max({0}) OVER w AS {0}')}
FROM (
  SELECT k.target_id, k.disease_id, k.year, {listing(PAIR_FEATURES, 'o.{0}')},
    t.best AS {ENTITY[0]}, d.best AS {ENTITY[1]}
  FROM (
    SELECT o.target_id, o.disease_id, o.year FROM v_own o
      SEMI JOIN v_stages s ON s."targetId"=o.target_id AND s."diseaseId"=o.disease_id
    UNION
    SELECT p."targetId", p."diseaseId", y.year FROM v_stages p JOIN v_stages y ON y."targetId"=p."targetId"
    UNION
    SELECT p."targetId", p."diseaseId", y.year FROM v_stages p
      JOIN (SELECT DISTINCT "diseaseId", year FROM v_stages) y ON y."diseaseId"=p."diseaseId") k
  LEFT JOIN v_own o ON o.target_id=k.target_id AND o.disease_id=k.disease_id AND o.year IS NOT DISTINCT FROM k.year
  LEFT JOIN (SELECT "targetId" AS i, year, max("clinicalPhaseMaxReached") AS best FROM v_stages GROUP BY 1,2) t
    ON t.i=k.target_id AND t.year=k.year
  LEFT JOIN (SELECT "diseaseId" AS i, year, max("clinicalPhaseMaxReached") AS best FROM v_stages GROUP BY 1,2) d
    ON d.i=k.disease_id AND d.year=k.year)
WINDOW w AS (PARTITION BY target_id, disease_id ORDER BY year ASC NULLS LAST
             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""

VIEWS["v_static"] = f"""
SELECT o.target_id, o.disease_id, CAST(NULL AS INT) AS year, {listing(PAIR_FEATURES, 'o.{0}')},
  t.best AS {ENTITY[0]}, d.best AS {ENTITY[1]}
FROM (SELECT target_id, disease_id, {listing(PAIR_FEATURES, 'max({0}) AS {0}')} FROM v_own GROUP BY 1,2) o
LEFT JOIN (SELECT "targetId" AS i, max("clinicalPhaseMaxReached") AS best FROM v_stages GROUP BY 1) t ON t.i=o.target_id
LEFT JOIN (SELECT "diseaseId" AS i, max("clinicalPhaseMaxReached") AS best FROM v_stages GROUP BY 1) d ON d.i=o.disease_id"""

VIEWS["v_target_features"] = """
SELECT "targetId" AS target_id, "tissueSpecificity" AS target__tissue_specificity,
  "tissueDistribution" AS target__tissue_distribution, "geneticConstraint" AS target__genetic_constraint,
  "mouseKOScore" AS target__mouse_ko_score FROM v_prioritisation"""

VIEWS["v_features"] = f"""
SELECT v_temporal.*, {listing(TARGET_STATIC)} FROM v_temporal LEFT JOIN v_target_features USING (target_id)"""

VIEWS["v_present"] = f"""
SELECT v_static.*, {listing(TARGET_STATIC)} FROM v_static LEFT JOIN v_target_features USING (target_id)"""

STATIC = [n for n in [*ALL_FEATURES, *TARGET_STATIC] if "__genetic_association__" in n or n in TARGET_STATIC]
TEMPORAL = [n for n in [*ALL_FEATURES, *TARGET_STATIC] if n not in STATIC]
OUTCOME = "target_disease__outcome__advanced"
TIME = "target_disease__time__transition"

VIEWS["v_transitions"] = """
SELECT target_id, disease_id, min(year) AS transition_year FROM v_features
WHERE year IS NOT NULL AND target_disease__clinical__phase2__reached>0
  AND target_disease__clinical__phase_max__reached<=2 GROUP BY 1,2"""

VIEWS["v_base"] = f"""
SELECT t.target_id, t.disease_id, t.transition_year, {listing(STATIC, 's.{0}')}, a.feature_year,
  {listing(TEMPORAL, 'f.{0}')}, d.year_first_advanced
FROM v_transitions t
JOIN (SELECT target_id, disease_id, {listing(STATIC, 'max({0}) AS {0}')} FROM v_features GROUP BY 1,2) s
  USING (target_id, disease_id)
LEFT JOIN (SELECT target_id, disease_id, max(year) AS feature_year FROM v_features JOIN v_transitions USING (target_id, disease_id)
      WHERE year<transition_year GROUP BY 1,2) a USING (target_id, disease_id)
LEFT JOIN v_features f ON f.target_id=t.target_id AND f.disease_id=t.disease_id AND f.year=a.feature_year
LEFT JOIN (SELECT target_id, disease_id, min(year) AS year_first_advanced FROM v_features
      WHERE year IS NOT NULL AND target_disease__clinical__phase_max__reached>2 GROUP BY 1,2) d
  ON d.target_id=t.target_id AND d.disease_id=t.disease_id"""

# The earlier release of the sweep knows the years up to 1999.
VIEWS["v_features_early"] = "SELECT * FROM v_features WHERE year IS NULL OR year<=1999"
for _name in ("v_transitions", "v_base"):
    VIEWS[f"{_name}_early"] = VIEWS[_name].replace("v_features", "v_features_early").replace("v_transitions", "v_transitions_early")


def cohort_sql(first: int, last: int, advanced_by: int) -> str:
    return f"""
SELECT * EXCLUDE (year_first_advanced),
  year_first_advanced IS NOT NULL AND year_first_advanced<={advanced_by} AS {OUTCOME},
  CAST({advanced_by}-transition_year AS INT) AS {TIME}
FROM v_base WHERE transition_year BETWEEN {first} AND {last}"""


VIEWS["v_cohort"] = cohort_sql(1996, 1998, 1999)
VIEWS["v_evaluation"] = cohort_sql(1999, 1999, 2001)
VIEWS["v_splits"] = """
SELECT *, 'training' AS split FROM v_cohort UNION ALL BY NAME SELECT *, 'evaluation' AS split FROM v_evaluation"""

VIEWS["v_advancement"] = f"""
SELECT split_part(feature,'__',2)||'__'||split_part(feature,'__',3) AS feature_name,
  CASE WHEN fy IS NULL THEN 'none' WHEN fy<reached THEN 'before' ELSE 'after' END AS emerged,
  CASE WHEN surpassed IS NULL THEN 'stalled' ELSE 'advanced' END AS progress, count(*) AS n_pairs
FROM (
  SELECT target_id, disease_id,
    min(CASE WHEN early>0 THEN year END) AS reached,
    min(CASE WHEN early>0 AND target_disease__clinical__phase_max__reached>2 THEN year END) AS surpassed,
    {listing(SCORES, 'min(CASE WHEN {0}>0 THEN year END) AS {0}')}
  FROM (SELECT *, greatest(0, coalesce(target_disease__clinical__phase1__reached,0), coalesce(target_disease__clinical__phase2__reached,0)) AS early
        FROM v_features WHERE year IS NOT NULL) GROUP BY 1,2)
UNPIVOT INCLUDE NULLS (fy FOR feature IN ({listing(SCORES)}))
WHERE reached BETWEEN 1996 AND 1999 GROUP BY 1,2,3"""


def fisher_sql(a: str, b: str, c: str, d: str) -> str:
    """Upper hypergeometric tail by log-gamma."""
    lf = "lgamma({0}+1.0)".format
    row, col, tot = f"({a}+{b})", f"({a}+{c})", f"({a}+{b}+{c}+{d})"
    const = f"{lf(row)}+{lf(tot + '-' + row)}+{lf(col)}+{lf(tot + '-' + col)}-{lf(tot)}"
    term = f"exp({const}-{lf('x')}-{lf(row + '-x')}-{lf(col + '-x')}-{lf(tot + '-' + row + '-' + col + '+x')})"
    return f"least(1.0, (SELECT sum({term}) FROM (SELECT unnest(range({a}, least({row},{col})+1)) AS x)))"


def rr_sql(a: str, n1: str, c: str, n0: str, z: float) -> dict[str, str]:
    rr = f"(({a})/({n1})::DOUBLE)/(({c})/({n0})::DOUBLE)"
    sd = f"{z!r}*sqrt(1.0/({a})-1.0/({n1})+1.0/({c})-1.0/({n0}))"

    def pick(both: str, none_exposed: str, none_control: str) -> str:
        return f"(CASE WHEN ({a})>0 AND ({c})>0 THEN {both} WHEN ({a})=0 AND ({c})>0 THEN {none_exposed} WHEN ({a})>0 THEN {none_control} END)"

    return {
        "relative_risk": pick(rr, "0.0", "'inf'::DOUBLE"),
        "relative_risk_low": pick(f"exp(ln({rr})-{sd})", "0.0", "NULL"),
        "relative_risk_high": pick(f"exp(ln({rr})+{sd})", "NULL", "'inf'::DOUBLE"),
    }


Z90, Z99 = 1.6448536269514722, 2.5758293035489004

VIEWS["v_wx"] = """
SELECT l_linenumber, l_returnflag, l_suppkey%25 AS nation, max(l_quantity) AS v FROM lineitem GROUP BY 1,2,3"""

MODEL_NAMES = ["rdg__no_time__positive", "rdg__all__positive", "ots__all"]
_LINEAR = " + ".join(
    [f"{round(0.01 * (i + 1), 2)}::DOUBLE*coalesce({c},0)" for i, c in enumerate(SCORES)]
    + [f"0.05::DOUBLE*coalesce({ENTITY[0]},0)", f"0.01::DOUBLE*coalesce({ENTITY[1]},0)",
       "0.1::DOUBLE*coalesce(target__tissue_specificity,0)", "0.05::DOUBLE*coalesce(target__genetic_constraint,0)"]
)
_COMPOSITE = "(" + " + ".join(
    f"{0.2 if c.endswith(('europepmc', 'impc')) else 1.0}::DOUBLE*coalesce({c},0)" for c in SCORES
) + f")/{len(SCORES)}"


def scored_sql(source: str) -> str:
    return f"""
SELECT *, round(greatest(0.0,least(1.0,{_LINEAR})),6) AS rdg__no_time__positive,
  round(greatest(0.0,least(1.0,{_LINEAR} + 0.03::DOUBLE*{TIME})),6) AS rdg__all__positive,
  round({_COMPOSITE},6) AS ots__all FROM {source}"""


VIEWS["v_scored"] = scored_sql("v_cohort")
VIEWS["v_predictions"] = f"""
SELECT target_id, disease_id, {OUTCOME} AS y, model, prediction FROM v_scored
UNPIVOT (prediction FOR model IN ({listing(MODEL_NAMES)}))"""
VIEWS["v_scored_area"] = "SELECT * FROM v_scored JOIN v_areas USING (disease_id)"

RANKED_FEATURES = [*PHASES, *SCORES, TIME, *ENTITY, *TARGET_STATIC]
QUANTILES = (0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95)
LIMITS = (10, 25, 50, 75, 100, 250, 500)


def methods_sql(source: str, by: list[str]) -> str:
    """Rows (by, method, src, test, cutoff)."""
    group = "".join(f"{b}, " for b in by)
    grouping = f"GROUP BY {', '.join(by)}" if by else ""
    over = f"PARTITION BY {', '.join(by)}" if by else ""
    parts = [
        f"SELECT {group}'{c}' AS method, '{c}' AS src, 'pos' AS test, 0.0::DOUBLE AS cutoff FROM {source} {grouping} "
        + ("" if by else "LIMIT 1")
        for c in [*PHASES, *SCORES, TIME]
    ]
    parts = [f"({p})" for p in parts]
    parts.append(f"SELECT DISTINCT {group}'{TIME}__eq_'||CAST({TIME} AS BIGINT), '{TIME}', 'eq', {TIME}::DOUBLE FROM {source}")

    def ranked(col: str, label: str, limits) -> list[str]:
        return [
            f"(SELECT {group}'{label}__limit_{k:04d}', '{col}', 'gte', min({col})::DOUBLE FROM "
            f"(SELECT {group}{col}, row_number() OVER ({over} ORDER BY {col} DESC) AS rn FROM {source} WHERE {col} IS NOT NULL) WHERE rn<={k} {grouping})"
            for k in limits
        ]

    parts += ranked("target_disease__literature__europepmc", "target_disease__literature__europepmc", (100, 250, 500))
    for m in MODEL_NAMES:
        parts += ranked(m, f"target_disease__model__{m}", LIMITS)
    for c in [*ENTITY, *TARGET_STATIC]:
        key = f"{c.split('__')[0]}_id"
        best = f"(SELECT {group}{key}, max({c})::DOUBLE AS v FROM {source} GROUP BY {group}{key})"
        n_of = f"(SELECT {group}count(DISTINCT v) AS nd, bool_and(v=floor(v)) AS whole FROM {best} {grouping})"
        using = f"JOIN {n_of} n USING ({', '.join(by)})" if by else f"CROSS JOIN {n_of} n"
        parts.append(
            f"SELECT DISTINCT {group}'{c}__gte_'||CASE WHEN whole THEN CAST(CAST(v AS BIGINT) AS VARCHAR) ELSE CAST(v AS VARCHAR) END, '{c}', 'gte', v "
            f"FROM {best} b {using} WHERE v IS NOT NULL AND nd<=10"
        )
        for q in QUANTILES:
            parts.append(
                f"(SELECT {group}'{c}__qtl_{int(100 * q + 1e-9):03d}', '{c}', 'gte', quantile_cont(v, {q}) FROM {best} {grouping} HAVING count(DISTINCT v)>10)"
            )
    return "\nUNION ALL ".join(parts)


RISK_VALUES = ["fraction_exposed", "fraction_control", "relative_risk", "relative_risk_low", "relative_risk_high"]


def risk_sql(source: str, methods: str, by: list[str], z: float, show=r6) -> str:
    """Relative risk per method by joining every row to every method: brute force on purpose. Reports
    that average the risks take them as they are (``show=exact``)."""
    group = "".join(f"{b}, " for b in by)
    match = " AND ".join(["TRUE", *[f"s.{b}=m.{b}" for b in by]])
    columns = [*RANKED_FEATURES, *MODEL_NAMES]
    value = "CASE m.src " + " ".join(f"WHEN '{c}' THEN s.{c}::DOUBLE" for c in columns) + " END"
    hit = f"coalesce(CASE m.test WHEN 'pos' THEN {value}>0 WHEN 'eq' THEN {value}=m.cutoff ELSE {value}>=m.cutoff END, FALSE)"
    rr = rr_sql("a", "n1", "c", "n0", z)
    return f"""
SELECT {group}method, n1 AS n_exposed, a AS n_exposed_true, n0 AS n_control, n1+n0 AS n_total,
  {show('a/n1::DOUBLE', 'fraction_exposed')}, {show('c/n0::DOUBLE', 'fraction_control')},
  {', '.join(show(v, k) for k, v in rr.items())}
FROM (SELECT {''.join(f's.{b}, ' for b in by)}method, count(*) FILTER (WHERE hit) AS n1, count(*) FILTER (WHERE hit AND y) AS a,
        count(*) FILTER (WHERE NOT hit) AS n0, count(*) FILTER (WHERE NOT hit AND y) AS c
      FROM (SELECT {''.join(f's.{b}, ' for b in by)}m.method, s.{OUTCOME} AS y, {hit} AS hit FROM {source} s JOIN {methods} m ON {match}) s
      GROUP BY ALL)
WHERE n1>0 AND n0>0"""


_AREA = ["therapeutic_area_id", "therapeutic_area_name"]
VIEWS["v_methods"] = methods_sql("v_scored", [])
VIEWS["v_methods_area"] = methods_sql("v_scored_area", _AREA)
VIEWS["v_risk"] = risk_sql("v_scored", "v_methods", [], Z90)
VIEWS["v_risk_area"] = risk_sql("v_scored_area", "v_methods_area", _AREA, Z90, exact)
_SLUGS = {"rdg__no_time__positive": "RDG", "rdg__all__positive": "RDG-T", "rdg__no_tgc__positive": "RDG-X",
          "gbm__all__unconstrained": "GBM-T", "ots__all": "OTS"}
_BENCH = {"omim": ("OMIM", "OMIM"), "eva": ("EVA", "EVA/ClinVar"), "ot_genetics_portal": ("OTG", "OTG/GWAS")}


def enriched_sql(source: str) -> str:
    slug = "CASE model_name " + " ".join(f"WHEN '{m}' THEN '{s}'" for m, s in _SLUGS.items()) + " END"
    bench = "CASE method " + " ".join(f"WHEN 'target_disease__genetic_association__{b}' THEN '{b}'" for b in _BENCH) + " END"
    of = [
        "CASE benchmark_name " + " ".join(f"WHEN '{b}' THEN '{v[i]}'" for b, v in _BENCH.items()) + " END" for i in (0, 1)
    ]
    return f"""
SELECT *, {of[0]} AS benchmark_slug, {of[1]} AS benchmark_disp, {slug} AS model_slug, model_name IS NOT NULL AS is_model_feature,
  {slug} IS NOT NULL AS is_primary_model_feature, benchmark_name IS NOT NULL AS is_primary_benchmark_feature
FROM (SELECT *, nullif(regexp_extract(method,'^target_disease__model__(.+)__limit_[0-9]+$',1),'') AS model_name,
        TRY_CAST(nullif(regexp_extract(method,'__limit_([0-9]+)$',1),'') AS INT) AS "limit", {bench} AS benchmark_name FROM {source})"""


VIEWS["v_enriched"] = enriched_sql("v_risk")
VIEWS["v_enriched_area"] = enriched_sql("v_risk_area")
VIEWS["v_thresholds"] = """
SELECT l.*, p.prediction AS model_prediction_threshold FROM (
  SELECT m.model_name AS model, b.benchmark_name, b.benchmark_slug, b.relative_risk AS benchmark_relative_risk, b.n_exposed AS benchmark_n_pairs,
    max(CASE WHEN m.relative_risk>b.relative_risk THEN m."limit" END) AS limit_lower_bound,
    min(CASE WHEN m.relative_risk<=b.relative_risk THEN m."limit" END) AS limit_upper_bound,
    (max(CASE WHEN m.relative_risk>b.relative_risk THEN m."limit" END) + min(CASE WHEN m.relative_risk<=b.relative_risk THEN m."limit" END))/2.0::DOUBLE AS "limit"
  FROM (SELECT * FROM v_enriched WHERE is_primary_model_feature) m
  CROSS JOIN (SELECT * FROM v_enriched WHERE is_primary_benchmark_feature) b GROUP BY ALL
  HAVING limit_lower_bound IS NOT NULL OR limit_upper_bound IS NOT NULL) l
LEFT JOIN (SELECT model, prediction, row_number() OVER (PARTITION BY model ORDER BY prediction DESC) AS rn FROM v_predictions) p
  ON p.model=l.model AND p.rn=CAST(floor(l."limit") AS INT)"""

VIEWS["v_items"] = """
SELECT l_linestatus, l_orderkey, l_linenumber, l_partkey, l_extendedprice, (l_returnflag='R')::INT::DOUBLE AS y, round(l_discount*10,1) AS score FROM lineitem"""


def cell_metrics_sql(rows: str, by: str) -> str:
    """ROC AUC and average precision from counts per distinct score."""
    return f"""
SELECT {by}, {r6('sum(pos*(neg_total-neg_cum+(n-pos)/2.0::DOUBLE))/nullif(max(pos_total)*max(neg_total),0)::DOUBLE', 'roc_auc')},
  {r6('coalesce(sum(pos*(pos_cum/n_cum::DOUBLE))/nullif(max(pos_total),0)::DOUBLE,0)', 'average_precision')}
FROM (SELECT *, sum(n) OVER w AS n_cum, sum(pos) OVER w AS pos_cum, sum(n-pos) OVER w AS neg_cum,
        sum(pos) OVER (PARTITION BY {by}) AS pos_total, sum(n-pos) OVER (PARTITION BY {by}) AS neg_total
      FROM (SELECT {by}, score, count(*) AS n, count(*) FILTER (WHERE y>0) AS pos FROM {rows} GROUP BY {by}, score)
      WINDOW w AS (PARTITION BY {by} ORDER BY score DESC))
GROUP BY {by}"""


def threshold_metrics_sql(rows: str, by: str) -> str:
    return f"""
SELECT {by}, n_samples, n_positives, {r6('n_positives/n_samples::DOUBLE', 'balance')},
  {r6('coalesce(tp/nullif(tp+fp,0),0)', '"precision"')}, {r6('coalesce(tp/nullif(tp+fn,0),0)', 'recall')},
  {r6('coalesce(2*tp/nullif(2*tp+fp+fn,0),0)', 'f1')},
  {r6('coalesce((tp*tn-fp*fn)/nullif(sqrt(tp+fp)*sqrt(tp+fn)*sqrt(tn+fp)*sqrt(tn+fn),0),0)', 'mcc')}
FROM (SELECT {by}, count(*) AS n_samples, count(*) FILTER (WHERE y>0) AS n_positives,
    (count(*) FILTER (WHERE y>0 AND coalesce(score>0.5,FALSE)))::DOUBLE AS tp, (count(*) FILTER (WHERE y<=0 AND score>0.5))::DOUBLE AS fp,
    (count(*) FILTER (WHERE y>0 AND NOT score>0.5))::DOUBLE AS fn, (count(*) FILTER (WHERE y<=0 AND NOT score>0.5))::DOUBLE AS tn
  FROM {rows} GROUP BY {by})"""


def calibration_sql(rows: str, by: str) -> str:
    p = "greatest(2.220446049250313e-16, least(1-2.220446049250313e-16, score))"
    return f"""
SELECT {by}, {r6('avg((y-score)*(y-score))', 'brier')},
  {r6('(avg(abs(y-score)) FILTER (WHERE y>0)+avg(abs(y-score)) FILTER (WHERE y<=0))/2', 'balanced_mae')},
  {r6(f'CASE WHEN min(y)<max(y) THEN -avg(y*ln({p})+(1-y)*ln(1-{p})) END', 'log_loss')}
FROM {rows} GROUP BY {by}"""


def at_ranks_sql(rows: str, by: str, key: str, ranks) -> str:
    cols = []
    for k in ranks:
        cols.append(r6(f"(sum(y) FILTER (WHERE rn<={k}))/least({k},max(n))::DOUBLE", f'"precision@{k}"'))
        cols.append(r6(f"coalesce((sum(y*cum/rn) FILTER (WHERE rn<={k}))/nullif(sum(y) FILTER (WHERE rn<={k}),0),0)", f'"average_precision@{k}"'))
        cols.append(r6(f"(sum(y) FILTER (WHERE rn<={k}))/nullif(sum(y),0)", f'"recall@{k}"'))
    return f"""
SELECT {by}, {', '.join(cols)}
FROM (SELECT *, sum(y) OVER (PARTITION BY {by} ORDER BY rn) AS cum FROM (
    SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY score DESC NULLS LAST, {key}) AS rn, count(*) OVER (PARTITION BY {by}) AS n FROM {rows}))
GROUP BY {by}"""


VIEWS["v_area_rows"] = f"""
SELECT therapeutic_area_id, therapeutic_area_name, model, target_id, disease_id, y::INT::DOUBLE AS y, prediction AS score
FROM v_predictions JOIN v_areas USING (disease_id)"""
VIEWS["v_area_both"] = """
SELECT therapeutic_area_id, therapeutic_area_name, model FROM v_area_rows GROUP BY ALL HAVING min(y)<max(y)"""
_AREA_MODEL = "therapeutic_area_id, therapeutic_area_name, model"
VIEWS["v_area_metrics"] = f"""
SELECT * FROM v_area_both
JOIN ({threshold_metrics_sql('v_area_rows', _AREA_MODEL)}) USING ({_AREA_MODEL})
JOIN ({cell_metrics_sql('v_area_rows', _AREA_MODEL)}) USING ({_AREA_MODEL})
JOIN ({calibration_sql('v_area_rows', _AREA_MODEL)}) USING ({_AREA_MODEL})
JOIN ({at_ranks_sql('v_area_rows', _AREA_MODEL, 'target_id, disease_id', (*range(10, 100, 10), 150, 200, 250, 300, 400, 500, 1000))}) USING ({_AREA_MODEL})"""

VIEWS["v_queries"] = """
SELECT user_id, event_id, floor(value/20)::DOUBLE AS y, (event_id%97)::DOUBLE AS score FROM events WHERE value IS NOT NULL"""
VIEWS["v_query_binary"] = """
SELECT user_id, event_id, (y>0)::INT::DOUBLE AS y, (score-min(score) OVER w)/nullif(max(score) OVER w-min(score) OVER w,0) AS score
FROM v_queries WINDOW w AS (PARTITION BY user_id)"""
QUERY_RANKS = (3, 5, 10, 20, 50, 100, 200)
_GAIN = "sum(g*(CASE WHEN rn<={k} THEN 1/log2(rn+1.0) ELSE 0 END))"
VIEWS["v_ndcg"] = f"""
SELECT a.user_id, {', '.join(f'coalesce(a.g{k}/nullif(i.g{k},0),0) AS "ndcg@{k}"' for k in QUERY_RANKS)}
FROM (SELECT user_id, {', '.join(_GAIN.format(k=k) + f' AS g{k}' for k in QUERY_RANKS)} FROM (
        SELECT user_id, avg(y) OVER (PARTITION BY user_id, score) AS g, row_number() OVER (PARTITION BY user_id ORDER BY score DESC) AS rn FROM v_queries) GROUP BY 1) a
JOIN (SELECT user_id, {', '.join(_GAIN.format(k=k) + f' AS g{k}' for k in QUERY_RANKS)} FROM (
        SELECT user_id, y AS g, row_number() OVER (PARTITION BY user_id ORDER BY y DESC) AS rn FROM v_queries) GROUP BY 1) i USING (user_id)"""
VIEWS["v_kendall"] = """
SELECT user_id, net/nullif(sqrt(n0-n1)*sqrt(n0-n2),0) AS kendalls_tau FROM (
  SELECT user_id, sum(sign(a.y-b.y)*sign(a.score-b.score))/2.0::DOUBLE AS net, (count(*)-count(*) FILTER (WHERE a.event_id=b.event_id))/2.0::DOUBLE AS n0,
    (count(*) FILTER (WHERE a.score=b.score AND a.event_id<>b.event_id))/2.0::DOUBLE AS n1,
    (count(*) FILTER (WHERE a.y=b.y AND a.event_id<>b.event_id))/2.0::DOUBLE AS n2
  FROM v_queries a JOIN v_queries b USING (user_id) GROUP BY 1)"""
VIEWS["v_query_metrics"] = f"""
SELECT * FROM (SELECT user_id, count(*) FILTER (WHERE y>0) AS n_relevant FROM v_queries GROUP BY 1)
JOIN v_kendall USING (user_id) JOIN v_ndcg USING (user_id)
JOIN ({threshold_metrics_sql('v_query_binary', 'user_id')}) USING (user_id)
JOIN ({cell_metrics_sql('v_query_binary', 'user_id')}) USING (user_id)
JOIN ({calibration_sql('v_query_binary', 'user_id')}) USING (user_id)
JOIN ({at_ranks_sql('v_query_binary', 'user_id', 'event_id', QUERY_RANKS)}) USING (user_id)"""

GENETIC = [c for c in SCORES if "__genetic_association__" in c]
OPPORTUNITY_COLUMNS = [*ENTITY, PHASES[0], "target_disease__known_drug__chembl", *GENETIC]
VIEWS["v_opps"] = f"""
SELECT target_id, disease_id, {listing(OPPORTUNITY_COLUMNS)}, round(greatest(0.0,least(1.0,{_LINEAR})),6) AS prediction FROM v_present"""
_HIGH = ("(modality IN ('SM','PR','AB') AND evidence IN ('Approved Drug','Advanced Clinical','Phase 1 Clinical')) "
         "OR (modality='OC' AND evidence='Approved Drug')")
_MED = ("(modality='SM' AND evidence IN ('Structure with Ligand','High-Quality Ligand')) OR (modality='PR' AND evidence IN ('Literature','UniProt Ubiquitination')) "
        "OR (modality='AB' AND evidence IN ('UniProt loc high conf','GO CC high conf')) OR (modality='OC' AND evidence='Advanced Clinical')")
CONFIDENCE = f"CASE WHEN {_HIGH} THEN 'HIGH' WHEN {_MED} THEN 'MED' ELSE 'LOW' END"
VIEWS["v_tract"] = f"""
SELECT id AS target_id, modality, evidence FROM v_targets WHERE value
UNION SELECT id, modality, 'ALL' FROM v_targets WHERE value
UNION SELECT id, modality, {CONFIDENCE} FROM v_targets WHERE value"""
_STAGE = f"CASE WHEN coalesce({PHASES[0]},0)<=0 THEN 'NONE' ELSE 'Phase '||{PHASES[0]} END"
VIEWS["v_groupings"] = f"""
WITH s AS (SELECT *, {_STAGE} AS target_disease__stage FROM v_opps UNION ALL SELECT *, 'ALL' FROM v_opps),
m AS (SELECT *, 'ALL' AS target__tractability__modality, 'ALL' AS target__tractability__evidence FROM s
      UNION ALL SELECT s.*, modality, evidence FROM s JOIN v_tract USING (target_id))
SELECT *, 'ALL' AS disease__therapeutic_area FROM m
UNION ALL SELECT m.*, therapeutic_area_name FROM m JOIN v_areas USING (disease_id)
WHERE target__tractability__evidence IN ('ALL','HIGH','MED','LOW') AND therapeutic_area_name<>'all'"""
_GROUPING = "target_disease__stage, target__tractability__modality, target__tractability__evidence, disease__therapeutic_area"
VIEWS["v_opp_thresholds"] = "SELECT * FROM v_thresholds WHERE model='rdg__no_time__positive'"
VIEWS["v_opp_stats"] = f"""
SELECT {_GROUPING}, t.n_pairs, t.benchmark_name, t.benchmark_slug, t.o AS model__n_pairs__over_threshold, t.f AS feature__n_pairs__exists FROM (
  SELECT {_GROUPING}, n_pairs, 'NONE' AS benchmark_name, 'NONE' AS benchmark_slug, n_pairs AS o, n_pairs AS f
  FROM (SELECT {_GROUPING}, count(DISTINCT (target_id, disease_id)) AS n_pairs FROM v_groupings GROUP BY ALL)
  UNION ALL
  SELECT {_GROUPING}, count(DISTINCT (target_id, disease_id)), benchmark_name, benchmark_slug,
    count(DISTINCT (target_id, disease_id)) FILTER (WHERE prediction>=model_prediction_threshold),
    count(DISTINCT (target_id, disease_id)) FILTER (WHERE CASE benchmark_name WHEN 'omim' THEN target_disease__genetic_association__omim
      WHEN 'eva' THEN target_disease__genetic_association__eva ELSE target_disease__genetic_association__ot_genetics_portal END>0)
  FROM v_groupings CROSS JOIN v_opp_thresholds GROUP BY ALL) t"""

UPPER_TAIL = (
    "0.5-exp(-z*z/2)/sqrt(2*pi())*list_sum([sign(z)*exp((2*k+1)*ln(abs(z))-((k+1)*ln(2.0)+lgamma(k+1.5)-0.5*ln(pi()))) for k in range(0,150)])"
)


def signed_rank_sql(values: str, group: str, pair: str, item: str, value: str, base: str) -> str:
    """Unrounded rows (group, item, n_used, statistic, z, p_value)."""
    key = f"{group}, {item}"
    match = " AND ".join(f"b.{c.strip()} IS NOT DISTINCT FROM x.{c.strip()}" for c in f"{group}, {pair}".split(","))
    return f"""
SELECT {key}, n_used, statistic, z, CASE WHEN {item}='{base}' THEN 0.0 WHEN z=0 THEN 0.5 WHEN z>7 THEN 0.0 WHEN z<-7 THEN 1.0 ELSE {UPPER_TAIL} END AS p_value
FROM (
  SELECT {key}, n_used, statistic, CASE WHEN {item}<>'{base}' AND v>0 THEN (statistic-n_used*(n_used+1)/4.0)/sqrt(v) END AS z
  FROM (
    SELECT {key}, count(*) FILTER (WHERE used) AS n_used, coalesce(sum(rk) FILTER (WHERE used AND d>0),0)::DOUBLE AS statistic,
      n_used*(n_used+1)*(2*n_used+1)/24.0::DOUBLE - coalesce(sum(ties*ties-1) FILTER (WHERE used),0)/48.0::DOUBLE AS v
    FROM (
      SELECT *, rank() OVER (PARTITION BY {key}, used ORDER BY abs(d)) + (count(*) OVER (PARTITION BY {key}, used, abs(d))-1)/2.0::DOUBLE AS rk,
        count(*) OVER (PARTITION BY {key}, used, abs(d)) AS ties
      FROM (SELECT *, d IS NOT NULL AND d<>0 AS used FROM (
        SELECT {', '.join('x.' + c.strip() for c in key.split(','))}, CASE WHEN NOT isnan(x.{value}-b.{value}) THEN x.{value}-b.{value} END AS d
        FROM {values} x JOIN {values} b ON {match} AND b.{item}='{base}')))
    GROUP BY {key}))"""


AREAS = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST", "all"]


def area_report_sql(enriched: str, single_models: str, config: str) -> str:
    """``single_models`` names a view with the primary-model rows of the single areas."""
    c = f"{config}, " if config else ""
    described = ["model_name", "model_slug", "benchmark_name", "benchmark_slug", "benchmark_disp", "is_model_feature",
                 "is_primary_model_feature", "is_primary_benchmark_feature"]
    kept = f"FROM {enriched} WHERE n_total>=2 AND therapeutic_area_name IN ({listing(AREAS, chr(39) + '{0}' + chr(39))}) AND (is_primary_benchmark_feature OR is_model_feature)"
    return f"""
SELECT s.*, p.p_value FROM (
  SELECT {c}method, "limit", therapeutic_area_name, n_total, relative_risk, relative_risk_low, relative_risk_high, {listing(described)},
    CAST(NULL AS BIGINT) AS n_therapeutic_areas {kept}
  UNION ALL
  SELECT {c}method, "limit", 'average', NULL, avg(relative_risk), NULL, NULL, {listing(described, 'any_value({0})')}, count(*)
  {kept} AND therapeutic_area_name<>'all' GROUP BY {c}method, "limit") s
LEFT JOIN ({signed_rank_sql(single_models, f'{c}"limit"', 'therapeutic_area_name', 'model_slug', 'relative_risk', 'OTS')}) p
  ON p.model_slug=s.model_slug AND p."limit"=s."limit" {''.join(f' AND p.{x.strip()}=s.{x.strip()}' for x in config.split(',') if x)}"""


VIEWS["v_single_models"] = "SELECT * FROM v_enriched_area WHERE n_total>=2 AND therapeutic_area_name<>'all' AND is_primary_model_feature"
VIEWS["v_area_report"] = area_report_sql("v_enriched_area", "v_single_models", "")

SWEEP = [(y, w) for y in (1996, 1997, 1998) for w in (1, 2)]
_PAIRS = ", ".join(str(p) for p in SWEEP)
VIEWS["v_sweep"] = f"""
SELECT b.* EXCLUDE (year_first_advanced), c.y AS last_training_year, c.w AS "window", c.split, CAST(c.until-transition_year AS INT) AS {TIME},
  year_first_advanced IS NOT NULL AND year_first_advanced<=c.until AS {OUTCOME}
FROM (SELECT *, '23.12' AS version FROM v_base UNION ALL BY NAME SELECT *, '23.09' AS version FROM v_base_early) b JOIN (
  SELECT y, w, 'training' AS split, 1996 AS lo, y AS hi, y+w AS until FROM (VALUES {_PAIRS}) t(y,w)
  UNION ALL SELECT y, w, 'evaluation', y+1, 2000-w, 2000 FROM (VALUES {_PAIRS}) t(y,w)) c
ON transition_year BETWEEN c.lo AND c.hi"""
VIEWS["v_sweep_scored"] = scored_sql("v_sweep") + " WHERE split='evaluation'"
VIEWS["v_sweep_area"] = "SELECT * FROM v_sweep_scored JOIN v_areas USING (disease_id)"
_SWEEP_BY = ["version", "last_training_year", '"window"', *_AREA]
VIEWS["v_sweep_methods"] = f"SELECT * FROM ({methods_sql('v_sweep_area', _SWEEP_BY)}) WHERE contains(method, '__model__')"
VIEWS["v_sweep_risk"] = risk_sql("v_sweep_area", "v_sweep_methods", _SWEEP_BY, Z90, exact)
VIEWS["v_sweep_enriched"] = enriched_sql("v_sweep_risk")
VIEWS["v_sweep_single"] = "SELECT * FROM v_sweep_enriched WHERE n_total>=2 AND therapeutic_area_name<>'all' AND is_primary_model_feature"
VIEWS["v_sweep_report"] = area_report_sql("v_sweep_enriched", "v_sweep_single", 'version, last_training_year, "window"')

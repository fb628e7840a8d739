"""Queries on tokens, similarities and the mapping of terms to concepts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vocabula import dictionaries as d
from vocabula.functions import naming
from vocabula.functions import similarity as sim
from vocabula.functions import tokens as tok
from vocabula.operators import mapping as m
from vocabula.plans import views
from vocabula.plans.views import CONCEPTS_SQL, TERMS_SQL
from vocabula.plans.views import SPACE_SQL as SP
from vocabula.scale import cut
from vocabula.session import table


def tokens_identifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "code_concepts").select("concept_row", tok.tokenize(F.col("name")).alias("tokens"))


def tokens_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "code_concepts").select("concept_row", tok.tokenize_path(F.col("filePath")).alias("tokens"))


def tokens_sentence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "glossary_terms").select("row_id", tok.tokenize_sentence(F.col("definition")).alias("tokens"))


def normalize_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "glossary_terms").select("row_id", tok.normalize(F.col("name")).alias("normalized"))


def case_convert(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("name")
    return table(spark, sf_dir, "learned_terms").select(
        "learned_id",
        naming.camel_case(n).alias("camel"),
        naming.pascal_case(n).alias("pascal"),
        naming.snake_case(n).alias("snake"),
        naming.kebab_case(n).alias("kebab"),
        naming.convention(n).alias("convention"),
        naming.in_convention(n, naming.convention(n)).alias("kept"),
        naming.truncate(n, 12).alias("short"),
    )


def humanized_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "code_concepts").select("concept_row", naming.humanize(F.col("name")).alias("human"))


def _own(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each concept with its own path and description: overlaps that need no join."""
    return m.concept_tokens(views.concepts(spark, sf_dir))


def jaccard_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _own(spark, sf_dir).select("concept_id", sim.jaccard(F.col("c_name"), F.col("c_path")).alias("jaccard"))


def partial_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _own(spark, sf_dir).select("concept_id", F.round(sim.partial_overlap(F.col("c_name"), F.col("c_path")), 9).alias("overlap"))


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return m.term_tokens(views.terms(spark, sf_dir)), m.concept_tokens(views.concepts(spark, sf_dir))


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.postings(_sides(spark, sf_dir)[1])


def candidate_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.candidates(*_sides(spark, sf_dir))


def mapping_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.all_scores(*_sides(spark, sf_dir), brief=True)


def mapping_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.mappings(*_sides(spark, sf_dir)).select("term_id", "concept_id", "confidence", "relationship", "strategies", "rank")


def mapping_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, c = map(cut, _sides(spark, sf_dir))
    return m.statistics(m.mappings(t, c), t, c).withColumn("mean_confidence", F.round("mean_confidence", 6))


def mapping_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Name containment of every term, candidates or not."""
    return m.contained_pairs(*_sides(spark, sf_dir))


# SQL ----------------------------------------------------------------------------------------------------------------
def _tok(s: str) -> str:
    cut = "".join(f"regexp_replace(" for _ in range(4)) + "x, '([a-z])([A-Z])', '\\1' || chr(1) || '\\2', 'g'), '([A-Z]+)([A-Z][a-z])', '\\1' || chr(1) || '\\2', 'g'), '([a-zA-Z])(\\d)', '\\1' || chr(1) || '\\2', 'g'), '(\\d)([a-zA-Z])', '\\1' || chr(1) || '\\2', 'g')"
    return (
        f"list_filter(list_transform(flatten(list_transform(list_filter(regexp_split_to_array(coalesce({s}, ''), '[{SP}_\\-./\\\\]+'), lambda x: x <> ''), "
        f"lambda x: CASE WHEN upper(x) = x THEN [x] ELSE string_split({cut}, chr(1)) END)), lambda x: lower(x)), lambda x: length(x) >= 2)"
    )


def _words(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def _uniq(a: str) -> str:
    """Distinct entries in order of first appearance."""
    return f"list_filter({a}, lambda x, i: list_position({a}, x) = i)"


def _of(sql: str, column: str) -> str:
    """The expression for a column."""
    return sql.replace("@@", column)


_NORM = f"trim(regexp_replace(regexp_replace(regexp_replace(lower(coalesce(@@, '')), '[_\\-]', ' ', 'g'), '[^A-Za-z0-9_{SP}]', '', 'g'), '[{SP}]+', ' ', 'g'))"
_SENT = f"list_filter(list_transform(regexp_split_to_array(regexp_replace(coalesce(@@, ''), '[^A-Za-z0-9_{SP}\\-]', ' ', 'g'), '[{SP}]+'), lambda x: lower(x)), lambda x: length(x) >= 2 AND NOT list_contains({_words(tok.STOP_WORDS)}, x))"
_SEGMENTS = f"list_filter(regexp_split_to_array(regexp_replace(coalesce(@@, ''), '([^/])\\.[^./]*$', '\\1'), '[/\\\\]'), lambda x: x <> '' AND NOT list_contains({_words(tok.GENERIC_SEGMENTS)}, lower(x)))"
_PATH = f"flatten(list_transform({_SEGMENTS}, lambda p: {_tok('p')}))"
_SQUEEZE = f"regexp_replace(@@, '[{SP}]', '', 'g')"


def _cov(a: str, b: str) -> str:
    return (
        f"(coalesce(list_sum(list_transform({a}, lambda x: CASE WHEN list_contains({b}, x) THEN 1.0::DOUBLE WHEN length(x) >= 3 THEN coalesce(list_max(list_transform("
        f"list_filter({b}, lambda y: length(y) >= 3 AND (starts_with(y, x) OR starts_with(x, y))), lambda y: least(length(x), length(y))::DOUBLE / greatest(length(x), length(y)) * 0.7::DOUBLE)), 0.0::DOUBLE) "
        f"ELSE 0.0::DOUBLE END)), 0.0::DOUBLE) / len({a}))"
    )


def _over(a: str, b: str) -> str:
    ab, ba = _cov(a, b), _cov(b, a)
    return f"CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0::DOUBLE WHEN {ab} = 0 OR {ba} = 0 THEN greatest({ab}, {ba}) * 0.7::DOUBLE ELSE sqrt({ab} * {ba}) END"


_CTOK = f"""{CONCEPTS_SQL}, ctok0 AS (SELECT id AS concept_id, kind, coalesce(exported, false) AS exported, {_of(_NORM, 'name')} AS c_norm, {_tok('name')} AS a, {_of(_PATH, 'filePath')} AS b, {_of(_SENT, 'description')} AS c FROM concepts),
ctok AS (SELECT concept_id, kind, exported, c_norm, {_uniq('a')} AS c_name, {_uniq('b')} AS c_path, {_uniq('c')} AS c_desc FROM ctok0)"""
_TTOK = f"""{TERMS_SQL}, ttok0 AS (SELECT id AS term_id, {_of(_NORM, 'name')} AS t_norm, list_transform(aliases, lambda z: {_of(_NORM, 'z')}) AS t_aliases, {_tok('name')} AS a, {_of(_SENT, 'definition')} AS b, list_transform(aliases, lambda z: {_tok('z')}) AS c FROM terms),
ttok AS (SELECT term_id, t_norm, t_aliases, {_uniq('a')} AS t_name, {_uniq('b')} AS t_def, c AS t_alias_sets FROM ttok0)"""
_POST = """post AS (SELECT 'name' AS field, unnest(c_name) AS token, concept_id FROM ctok UNION ALL SELECT 'path', unnest(c_path), concept_id FROM ctok UNION ALL SELECT 'description', unnest(c_desc), concept_id FROM ctok)"""
_CAND = f"""{_POST}, probe AS (SELECT DISTINCT * FROM (SELECT term_id, 'name' AS field, unnest(t_name) AS token FROM ttok UNION ALL SELECT term_id, 'path', unnest(t_name) FROM ttok
  UNION ALL SELECT term_id, 'description', unnest(t_def) FROM ttok UNION ALL SELECT term_id, 'name', unnest(flatten(t_alias_sets)) FROM ttok)),
tkey AS (SELECT term_id, unnest([t_norm, {_of(_SQUEEZE, 't_norm')}]) AS k FROM ttok UNION SELECT term_id, unnest([n, {_of(_SQUEEZE, 'n')}]) FROM (SELECT term_id, unnest(t_aliases) AS n FROM ttok)),
ckey AS (SELECT concept_id, unnest([c_norm, {_of(_SQUEEZE, 'c_norm')}]) AS k FROM ctok),
cand AS (SELECT DISTINCT term_id, concept_id FROM probe q JOIN post p ON p.field = q.field AND left(p.token, 3) = left(q.token, 3) AND (starts_with(p.token, q.token) OR starts_with(q.token, p.token))
  UNION SELECT t.term_id, c.concept_id FROM tkey t JOIN ckey c ON t.k = c.k AND t.k <> '')"""
_CONT = f"""cont AS (SELECT term_id, concept_id FROM (SELECT term_id, {_of(_SQUEEZE, 't_norm')} AS a FROM ttok) JOIN (SELECT concept_id, {_of(_SQUEEZE, 'c_norm')} AS b FROM ctok)
  ON length(a) >= 3 AND length(b) >= 3 AND (contains(a, b) OR contains(b, a)))"""

_case = f"list_filter(regexp_split_to_array(name, '[{SP}\\-_]+'), lambda x: x <> '')"
_cap = "upper(left(x, 1)) || lower(substr(x, 2))"
_pascal = f"array_to_string(list_transform({_case}, lambda x: {_cap}), '')"
_camel = f"array_to_string(list_transform({_case}, lambda x, i: CASE WHEN i = 1 THEN lower(x) ELSE {_cap} END), '')"
_snake = f"array_to_string(list_transform({_case}, lambda x: lower(x)), '_')"
_kebab = f"array_to_string(list_transform({_case}, lambda x: lower(x)), '-')"
_conv = "CASE WHEN contains(name, '_') THEN 'snake_case' WHEN contains(name, '-') THEN 'kebab-case' WHEN regexp_matches(name, '^[A-Z]') THEN 'PascalCase' WHEN regexp_matches(name, '[A-Z]') THEN 'camelCase' ELSE 'unknown' END"

QUERIES = {
    f.__name__: f
    for f in (
        tokens_identifier, tokens_path, tokens_sentence, normalize_name, case_convert, humanized_names, jaccard_overlap, partial_overlap, postings,
        candidate_pairs, mapping_scores, mapping_topk, mapping_stats, mapping_fallback,
    )
}
ORACLE = {
    "tokens_identifier": f"SELECT concept_row, {_tok('name')} AS tokens FROM code_concepts",
    "tokens_path": f"SELECT concept_row, {_uniq('t')} AS tokens FROM (SELECT concept_row, {_of(_PATH, 'filePath')} AS t FROM code_concepts)",
    "tokens_sentence": f"SELECT row_id, {_of(_SENT, 'definition')} AS tokens FROM glossary_terms",
    "normalize_name": f"SELECT row_id, {_of(_NORM, 'name')} AS normalized FROM glossary_terms",
    "case_convert": f"""SELECT learned_id, {_camel} AS camel, {_pascal} AS pascal, {_snake} AS snake, {_kebab} AS kebab, {_conv} AS convention,
        CASE {_conv} WHEN 'snake_case' THEN {_snake} WHEN 'kebab-case' THEN {_kebab} WHEN 'PascalCase' THEN {_pascal} ELSE {_camel} END AS kept,
        CASE WHEN length(name) <= 12 THEN name ELSE left(name, 9) || '...' END AS short FROM learned_terms""",
    "humanized_names": f"""SELECT concept_row, array_to_string(list_transform(list_filter(regexp_split_to_array(regexp_replace(regexp_replace(regexp_replace(name, '([a-z])([A-Z])', '\\1 \\2', 'g'),
        '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g'), '[_\\-]+', ' ', 'g'), '[{SP}]+'), lambda x: x <> ''), lambda x: upper(left(x, 1)) || substr(x, 2)), ' ') AS human FROM code_concepts""",
    "jaccard_overlap": f"""WITH {_CTOK} SELECT concept_id, CASE WHEN len(c_name) = 0 OR len(c_path) = 0 THEN 0.0 ELSE len(list_intersect(c_name, c_path))::DOUBLE / len(list_distinct(list_concat(c_name, c_path))) END AS jaccard FROM ctok""",
    "partial_overlap": f"WITH {_CTOK} SELECT concept_id, round({_over('c_name', 'c_path')}, 9) AS overlap FROM ctok",
    "postings": f"WITH {_CTOK}, {_POST} SELECT * FROM post",
    "candidate_pairs": f"WITH {_TTOK}, {_CTOK}, {_CAND} SELECT * FROM cand",
    "mapping_fallback": f"WITH {_TTOK}, {_CTOK}, {_CONT} SELECT * FROM cont",
}


def _case_map(column: str, values: dict, default: str) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {v!r}" + ("::DOUBLE" if isinstance(v, float) else "") for k, v in values.items()) + f" ELSE {default} END"


_PARTS = {
    "exact": f"""CASE WHEN t_norm = '' OR c_norm = '' THEN 0.0::DOUBLE WHEN t_norm = c_norm THEN 1.0::DOUBLE WHEN ts = cs THEN 0.95::DOUBLE WHEN length(ts) >= 3 AND length(cs) >= 3 AND contains(cs, ts)
        THEN 0.6::DOUBLE * (length(ts)::DOUBLE / length(cs)) WHEN length(ts) >= 3 AND length(cs) >= 3 AND contains(ts, cs) THEN 0.6::DOUBLE * (length(cs)::DOUBLE / length(ts)) ELSE 0.0::DOUBLE END""",
    "alias-exact": f"""CASE WHEN c_norm = '' THEN 0.0::DOUBLE ELSE coalesce(list_max(list_transform(t_aliases, lambda z: CASE WHEN z = c_norm THEN 1.0::DOUBLE WHEN {_of(_SQUEEZE, 'z')} = cs THEN 0.9::DOUBLE ELSE 0.0::DOUBLE END)), 0.0::DOUBLE) END""",
    "token-overlap": _over("t_name", "c_name"),
    "file-path": _over("t_name", "c_path"),
    "description": _over("t_def", "c_desc"),
    "alias-token": f"coalesce(list_max(list_transform(t_alias_sets, lambda z: {_over('z', 'c_name')})), 0.0::DOUBLE)",
}
_RAW = " + ".join(["0.0::DOUBLE"] + [f'"{k}" * {w}::DOUBLE' for k, w in d.STRATEGY_WEIGHTS.items()])
_ALL = f"""WITH {_TTOK.replace("c AS t_alias_sets", "list_transform(c, lambda z: list_filter(z, lambda x, i: list_position(z, x) = i)) AS t_alias_sets")}, {_CTOK}, {_CAND}, {_CONT},
pairs AS (SELECT * FROM cand UNION SELECT term_id, concept_id FROM cont WHERE term_id NOT IN (SELECT term_id FROM cand)),
parts AS (SELECT term_id, concept_id, kind, exported, {", ".join(f'{v} AS "{k}"' for k, v in _PARTS.items())}
  FROM (SELECT *, {_of(_SQUEEZE, 't_norm')} AS ts, {_of(_SQUEEZE, 'c_norm')} AS cs FROM pairs JOIN ttok USING (term_id) JOIN ctok USING (concept_id))),
scored AS (SELECT term_id, concept_id, kind, list_filter([{", ".join(f"CASE WHEN \"{k}\" > 0 THEN '{k}' END" for k in _PARTS)}], lambda x: x IS NOT NULL) AS strategies,
  floor(least(1.0::DOUBLE, greatest(0.0::DOUBLE, ({_RAW}) * (0.7::DOUBLE + 0.3::DOUBLE * {_case_map("kind", d.KIND_BONUS, "0.5::DOUBLE")}) + CASE WHEN exported THEN 0.05::DOUBLE ELSE 0.0::DOUBLE END)) * 1000.0::DOUBLE + 0.5::DOUBLE) / 1000.0::DOUBLE AS confidence FROM parts),
kept AS (SELECT * FROM scored WHERE len(strategies) > 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY term_id ORDER BY confidence DESC, concept_id) AS rank FROM kept WHERE confidence >= {d.MIN_CONFIDENCE}),
top AS (SELECT * FROM ranked WHERE rank <= {d.TOP_K})"""
ORACLE |= {
    "mapping_scores": _ALL + " SELECT term_id, concept_id, confidence, strategies FROM kept",
    "mapping_topk": _ALL + f" SELECT term_id, concept_id, confidence, {_case_map('kind', d.KIND_RELATIONSHIP, repr('uses'))} AS relationship, strategies, rank::INT AS rank FROM top",
    "mapping_stats": _ALL
    + " SELECT (SELECT count(*) FROM ttok) AS terms, (SELECT count(*) FROM ctok) AS concepts, count(*) AS mappings, count(DISTINCT term_id) AS mapped_terms, round(avg(confidence), 6) AS mean_confidence FROM top",
}

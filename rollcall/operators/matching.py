"""Linking students to registry persons."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollcall.functions.text import normalise_name, squeeze_name
from rollcall.operators.columns import STANDARD_CPF, ensure_standard_cpf, keep_existing, suffix_collisions
from rollcall.operators.keys import cut_to, first_per_key, join_per_key, join_written, newest_row_ids, wanted_keys
from rollcall.operators.registry import latest_with_cpf
from rollcall.workdir import settle

# Columns a minimal merge keeps, where present.
STUDENT_MERGE_COLUMNS = (STANDARD_CPF, "nm_aluno", "idt_estab", "cpf")
REGISTRY_MERGE_COLUMNS = (
    STANDARD_CPF, "NOME_PESSOA_CADUNICO", "DATA_NASC_CADUNICO", "RENDA_MEDIA_FAM", "CEP",
    "p.num_cpf_pessoa", "NOME", "DTA_NASC", "VLR_RENDA_MEDIA",
)


def merge_on(
    left: DataFrame, right: DataFrame, key: str, suffixes: tuple[str, str] = ("_ALUNO", "_CADUNICO")
) -> DataFrame:
    """Inner join on one column; rows without a key never match.

    Both sides are shuffled on the key directly, so AQE can split a hot key at run time.
    A key with n and m rows gives n * m: this is the merge as such, ``merge_metrics`` tells
    its size beforehand. For one row per student use ``merge_newest``.
    """
    for side, df in (("left", left), ("right", right)):
        if key not in df.columns:
            raise ValueError(f"{side} table has no column {key!r} to merge on")
    left, right = suffix_collisions(left, right, [key], suffixes)
    return left.join(right, key)


def merge_newest(
    students: DataFrame, registry: DataFrame, suffixes: tuple[str, str] = ("_ALUNO", "_CADUNICO")
) -> DataFrame:
    """Each student with the newest registry row of the same ``cpf_std``, one row per student.

    A hot id cannot multiply: the registry has one row for it, and AQE splits its students.
    Registry rows of other ids are left out before any is ranked.
    """
    known = cut_to(registry, wanted_keys(students, "cpf_std"), "cpf_std")
    return merge_with_latest(students, settle(latest_with_cpf(known), "per-key"), suffixes)


def merge_with_latest(students: DataFrame, latest: DataFrame, suffixes: tuple[str, str] = ("_ALUNO", "_CADUNICO")) -> DataFrame:
    """``merge_newest`` with a table that has one row per ``cpf_std`` already (``registry_by_id``)."""
    left, right = suffix_collisions(students, latest, ["cpf_std"], suffixes)
    return left.join(right, "cpf_std")


def merge_minimal(students: DataFrame, registry: DataFrame) -> DataFrame:
    """``merge_on`` the standard id with only the columns later steps use."""
    left = keep_existing(ensure_standard_cpf(students), STUDENT_MERGE_COLUMNS)
    right = keep_existing(ensure_standard_cpf(registry), REGISTRY_MERGE_COLUMNS)
    return merge_on(left, right, STANDARD_CPF, ("_ALUNO", "_CAD"))


def merge_by_cpf_or_enrolment(students: DataFrame, documents: DataFrame | None, registry: DataFrame) -> DataFrame:
    """Merge by id where documents are at hand, else by enrolment number."""
    if documents is not None and "cpf" in documents.columns and "cpf" in registry.columns:
        def standard(df: DataFrame) -> DataFrame:
            return df.withColumn("cpf", F.nullif(F.trim("cpf"), F.lit("")))

        return merge_on(standard(documents), standard(registry), "cpf", ("_ALUNO", "_CAD"))
    return merge_on(students, registry, "nro_int_aluno_estado", ("_ALUNO", "_CAD"))


def unique_persons(students: DataFrame, registry: DataFrame) -> DataFrame:
    """One merged row per id: its newest registry row with its lowest enrolment.

    The first row of each side is chosen before the join. That gives the first row of the
    full merge in (registry order, enrolment order) without producing its other rows.
    Registry rows of ids that no student has are left out before any is ranked.
    """
    registry = cut_to(registry, wanted_keys(students, "cpf_std"), "cpf_std")
    return unique_with_latest(students, latest_with_cpf(registry))


def unique_with_latest(students: DataFrame, latest: DataFrame) -> DataFrame:
    """``unique_persons`` with a table that has one row per ``cpf_std`` already (``registry_by_id``)."""
    return merge_with_latest(first_per_key(students, F.col("cpf_std"), [F.asc("matricula")]), latest)


def merge_metrics(students: DataFrame, registry: DataFrame) -> DataFrame:
    """Totals, rows with an id, merged rows and unique persons, without doing the merge.

    Both sides are counted per id first; a merge has n * m rows for an id.
    """
    left = students.groupBy("cpf_std").agg(F.count(F.lit(1)).alias("alunos"))
    right = registry.groupBy("cpf_std").agg(F.count(F.lit(1)).alias("pessoas"))
    pairs = left.join(right, "cpf_std", "full_outer")
    has_cpf = F.col("cpf_std").isNotNull()
    merged = has_cpf & F.col("alunos").isNotNull() & F.col("pessoas").isNotNull()

    def total(value: Column) -> Column:
        return F.coalesce(F.sum(value), F.lit(0)).cast("bigint")

    return pairs.agg(
        total(F.col("alunos")).alias("alunos_total"),
        total(F.when(has_cpf, F.col("alunos"))).alias("alunos_com_cpf"),
        total(F.col("pessoas")).alias("cad_total"),
        total(F.when(has_cpf, F.col("pessoas"))).alias("cad_com_cpf"),
        total(F.when(merged, F.col("alunos") * F.col("pessoas"))).alias("merge_linhas"),
        F.count_if(merged).alias("pessoas_unicas"),
    )


def require_cpfs(metrics: DataFrame) -> DataFrame:
    """The metrics as a written table, or an error when a side has no usable id at all."""
    metrics = settle(metrics, "metrics")
    row = metrics.first()
    require_ids({"com_cpf": row.alunos_com_cpf}, {"com_cpf": row.cad_com_cpf})
    return metrics


def require_ids(students: Mapping[str, int], registry: Mapping[str, int]) -> None:
    """An error when a side, by the counts observed as it was written, has no usable id at all."""
    for counts, side in ((students, "students"), (registry, "registry")):
        if counts["com_cpf"] == 0:
            raise ValueError(f"no usable CPF on the {side} side")


def missing_cpf_sample(df: DataFrame, key: str, n: int = 10) -> DataFrame:
    """The first ``n`` rows without a usable id, by ``key``."""
    return df.filter(F.col("cpf_std").isNull()).orderBy(key).limit(n)


def invalid_cpf_rows(df: DataFrame) -> DataFrame:
    """Rows whose id has no digits, for clean-up; they stay in the base table."""
    return df.filter(F.col("cpf_std").isNull())


def invalid_cpf_counts(students: DataFrame, registry: DataFrame, shown: int = 80) -> DataFrame:
    """Counts of ids without digits per side and the first ``shown`` distinct names."""
    bad = invalid_cpf_rows(registry)
    names = bad.select("nome").dropna().distinct().orderBy("nome").limit(shown)
    sample = names.agg(F.array_join(F.sort_array(F.collect_list("nome")), ", "))
    docs = invalid_cpf_rows(students).agg(F.count(F.lit(1)))
    return bad.agg(F.count(F.lit(1)).alias("invalid_cpf_cad_count")).select(
        docs.scalar().alias("invalid_cpf_docs_count"),
        "invalid_cpf_cad_count",
        sample.scalar().alias("invalid_cpf_cad_sample_names"),
    )


# Match rules in order: name -> (student columns, registry columns). Text is compared as a
# normalised name, except for columns that are standardised already.
STANDARDISED = ("cpf_std",)
MATCH_RULES: dict[str, tuple[Sequence[str], Sequence[str]]] = {
    "cpf": (["cpf_std"], ["cpf_std"]),
    "nome_mae": (["nm_aluno", "nm_mae"], ["nome", "nome_mae"]),
    "nome_nascimento": (["nm_aluno", "dt_nascimento"], ["nome", "dta_nasc"]),
}


def with_rule_keys(df: DataFrame, rules: Mapping[str, Sequence[str]]) -> DataFrame:
    """Adds ``_chave_<rule>``: one text from the rule's columns, empty when any is missing.

    Each column is normalised once, in a step of its own, and then used by all rules. The
    keys are never null: Spark would test a nullable join key in the scan and so compute
    every normalisation a second time.
    """
    types = dict(df.dtypes)
    used = dict.fromkeys(c for columns in rules.values() for c in columns)

    def part(column: str) -> Column:
        if types[column] == "date":
            text = F.unix_date(column).cast("string")
        elif types[column] == "string" and column not in STANDARDISED:
            text = squeeze_name(F.col(column))
        else:
            text = F.col(column).cast("string")
        return F.coalesce(text, F.lit(""))

    def key(columns: Sequence[str]) -> Column:
        texts = [F.col(f"_parte_{c}") for c in columns]
        if len(texts) == 1:
            return texts[0]
        missing = reduce(or_, [t == "" for t in texts])
        return F.when(missing, "").otherwise(F.concat_ws("\u0001", *texts))

    parts = df.select("*", *[part(c).alias(f"_parte_{c}") for c in used])
    keyed = parts.select("*", *[key(columns).alias(f"_chave_{rule}") for rule, columns in rules.items()])
    return keyed.drop(*[f"_parte_{c}" for c in used])


def rule_rows(df: DataFrame, rules: Mapping[str, Sequence[str]], *columns: str) -> DataFrame:
    """``columns`` and ``_chave`` (place of the rule and its key) for each rule that a row has a key for."""
    keyed = with_rule_keys(df, rules)
    keys = [F.when(F.col(f"_chave_{name}") != "", rule_key(i, name)) for i, name in enumerate(rules)]
    return keyed.select(*columns, F.explode(F.array_compact(F.array(*keys))).alias("_chave"))


def rule_key(place: int, rule: str) -> Column:
    return F.concat(F.lit(f"{place}\u0001"), F.col(f"_chave_{rule}"))


def newest_by_rule(
    students: DataFrame, registry: DataFrame, rules: Mapping[str, tuple[Sequence[str], Sequence[str]]]
) -> DataFrame:
    """``_chave`` and ``_row_id`` of the newest registry row per rule and key that a student has; a written table.

    The registry is scanned once for all rules. Its rows become one row per rule, and of these
    only those with a key of a student go on to be grouped.
    """
    wanted = wanted_keys(rule_rows(students, {n: own for n, (own, _) in rules.items()}), "_chave")
    people = rule_rows(registry, {n: theirs for n, (_, theirs) in rules.items()}, "row_id", "dat_atual_fam")
    best = newest_row_ids(cut_to(people, wanted, "_chave"), "_chave", "dat_atual_fam", "row_id")
    return settle(best.withColumnRenamed("row_id", "_row_id"), "matches")


def match_waterfall(
    students: DataFrame,
    registry: DataFrame,
    rules: Mapping[str, tuple[Sequence[str], Sequence[str]]] = MATCH_RULES,
) -> DataFrame:
    """Each student with the first rule that finds a registry person.

    Adds ``regra`` and ``cad_row_id``, null when no rule matches. Per rule the registry
    gives its newest row per key, so a student matches at most once; a student matched by
    an earlier rule, or without the rule's columns, has a null key. One chain of left joins
    with the few matched keys and row ids (``newest_by_rule``); ``layout.enrich_matched``
    adds columns of the matched rows.
    """
    best = newest_by_rule(students, registry, rules)
    keyed = with_rule_keys(students, {n: own for n, (own, _) in rules.items()})
    result = keyed.withColumns({"regra": F.lit(None).cast("string"), "cad_row_id": F.lit(None).cast("bigint")})
    for place, name in enumerate(rules):
        key = f"_chave_{name}"
        is_open = F.col("regra").isNull() & (F.col(key) != "")
        found = best.filter(F.col("_chave").startswith(f"{place}\u0001"))
        waiting = result.withColumn("_chave", F.when(is_open, rule_key(place, name)))
        result = join_written(waiting, found, "_chave", "left", "matricula").drop("_chave")
        rule = F.when(F.col("_row_id").isNotNull(), F.lit(name)).otherwise(F.col("regra"))
        result = result.withColumns({"regra": rule, "cad_row_id": F.coalesce("cad_row_id", "_row_id")}).drop("_row_id", key)
    return result


def unmatched(students: DataFrame, registry: DataFrame) -> DataFrame:
    """Students whose id is not in the registry, including those without one."""
    known = cut_to(registry.select("cpf_std"), wanted_keys(students, "cpf_std"), "cpf_std").distinct()
    return join_per_key(students, known, "cpf_std", "left_anti", "matricula")


def unmatched_with_latest(students: DataFrame, latest: DataFrame) -> DataFrame:
    """``unmatched`` with a table that has one row per ``cpf_std`` already (``registry_by_id``)."""
    without = students.filter(F.col("cpf_std").isNull())
    return students.dropna(subset=["cpf_std"]).join(latest.select("cpf_std"), "cpf_std", "left_anti").unionByName(without)


def cpf_conflicts(students: DataFrame, registry: DataFrame) -> DataFrame:
    """Students who share their id with a student of another name.

    ``manter`` says whether the student's name is the one the registry has for the id.
    """
    shared = settle(shared_ids(students), "shared")
    known = cut_to(registry.select("cpf_std", "nome", "dat_atual_fam", "row_id"), wanted_keys(shared, "cpf_std"), "cpf_std")
    return _conflicts(students, shared, latest_with_cpf(known))


def conflicts_with_latest(students: DataFrame, latest: DataFrame) -> DataFrame:
    """``cpf_conflicts`` with a table that has one row per ``cpf_std`` already (``registry_by_id``)."""
    return _conflicts(students, shared_ids(students), latest)


def shared_ids(students: DataFrame) -> DataFrame:
    """Ids that students of different names have."""
    return (
        students.filter(F.col("cpf_std").isNotNull())
        .select("cpf_std", normalise_name(F.col("nm_aluno")).alias("nome_norm"))
        .groupBy("cpf_std")
        .agg(F.countDistinct("nome_norm").alias("nomes"))
        .filter("nomes > 1")
        .select("cpf_std")
    )


def _conflicts(students: DataFrame, shared: DataFrame, latest: DataFrame) -> DataFrame:
    person = shared.join(latest.select("cpf_std", F.col("nome").alias("nome_cad")), "cpf_std")
    rows = join_per_key(students, person, "cpf_std", "inner", "matricula")
    same = normalise_name(F.col("nm_aluno")) == normalise_name(F.col("nome_cad"))
    return rows.withColumn("manter", F.coalesce(same, F.lit(False)))


def eligibility_funnel(matched: DataFrame, registry: DataFrame, cut: float) -> DataFrame:
    """Students read, mapped, unmapped, within the income cut and removed by it.

    Students are counted per registry row first; the counts are a written table, so
    ``matched`` is computed once, and only registry rows with a student are looked up.
    """
    per_row = settle(matched.groupBy("cad_row_id").agg(F.count(F.lit(1)).alias("alunos")), "per-row")
    income = registry.select(F.col("row_id").alias("cad_row_id"), F.col("renda_media").alias("_renda"))
    within = cut_to(income, wanted_keys(per_row, "cad_row_id"), "cad_row_id").filter(F.col("_renda") <= cut)

    def total(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, F.col("alunos"))), F.lit(0)).cast("bigint")

    mapped = F.col("cad_row_id").isNotNull()
    eligible = per_row.join(within, "cad_row_id").agg(total(F.lit(True))).scalar()
    return per_row.agg(
        total(F.lit(True)).alias("lidos"),
        total(mapped).alias("mapeados"),
        total(~mapped).alias("nao_mapeados"),
    ).select("*", eligible.alias("elegiveis"), (F.col("mapeados") - eligible).alias("removidos"))

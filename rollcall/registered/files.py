"""Registered queries: columns, file sources, sinks, the monthly run, arriving files.

Sources and sinks first write the given data to a fresh path under the shared folder,
then read it back.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from rollcall.fixtures import PERIOD, view, views, with_views
from rollcall.operators import columns as col
from rollcall.operators.history import accumulate, union_versions
from rollcall.operators.layout import beneficiary_layout as layout_of
from rollcall.plans.beneficiaries import layout_debug, publish_final_analysis, run_beneficiaries
from rollcall.operators.row_ids import with_content_ids
from rollcall.plans.monthly import publish_month, run_month
from rollcall.registered.matching import ADDRESS, CONFLICTS, HEADS, LOCATED, PERSON, beneficiary_layout, eligible_registry, waterfall
from rollcall.registered.matching import registry as view_registry
from rollcall.registered.matching import SQL as MATCHING_SQL
from rollcall.registered.sql import LATEST, RG, ST, WATERFALL, ctes, money, person
from rollcall.registered.students import SQL as STUDENT_SQL
from rollcall.schema import COLUMN_DICTIONARY, DELIMITERS, REGISTRY_DEFAULT_COLUMNS, REGISTRY_RENAMES, REGISTRY_SCAN_COLUMNS
from rollcall.sinks import files as sink
from rollcall.sinks import publish as publishing
from rollcall.sources import files as src
from rollcall.sources import registry_csv, registry_files
from rollcall.sources.roster import manual_roster_rejects, read_manual_roster
from rollcall.streaming import buckets as bucketed
from rollcall.streaming import incremental
from rollcall.workdir import fresh_path, settle

# Raw registry column -> expression over the registry view, in both SQL dialects.
RAW = {
    "d.cd_ibge": "cd_ibge", "d.cod_familiar_fam": "cod_fam", "d.nom_localidade_fam": "bairro",
    "d.nom_tip_logradouro_fam": "tipo_end", "d.nom_titulo_logradouro_fam": "titulo_end",
    "d.nom_logradouro_fam": "nome_end", "d.num_logradouro_fam": "num_end", "d.des_complemento_fam": "complem_1",
    "d.des_complemento_adic_fam": "complem_2", "d.num_cep_logradouro_fam": "cep",
    "d.vlr_renda_media_fam": money("renda_centavos"), "d.fx_rfpc": "fx_rfpc",
    "d.vlr_renda_total_fam": money("(renda_centavos*3)"), "d.marc_pbf": "marc_pbf",
    "d.num_ddd_contato_1_fam": "ddd_contato1", "d.num_tel_contato_1_fam": "num_tel_contato1",
    "d.num_ddd_contato_2_fam": "ddd_contato2", "d.num_tel_contato_2_fam": "num_tel_contato2",
    "p.nom_pessoa": "nome", "p.num_nis_pessoa_atual": "nis", "p.dta_nasc_pessoa": "cast(dta_nasc as string)",
    "p.num_cpf_pessoa": "cpf", "p.cod_parentesco_rf_pessoa": "cast(cod_parentesco as string)",
    "p.grau_instrucao": "grau_instrucao", "p.nom_completo_mae_pessoa": "nome_mae",
    "p.nom_completo_pai_pessoa": "nome_pai", "p.num_identidade_pessoa": "rg",
    "d.dat_atual_fam": "cast(dat_atual_fam as string)",
}
LINE = "concat_ws(';', " + ", ".join(f"coalesce({e}, '')" for e in RAW.values()) + ")"


def raw_registry(spark, d):
    return view(spark, d, "registry").select(*[F.expr(e).alias(c) for c, e in RAW.items()])


def _raw_sql(columns) -> str:
    chosen = ", ".join(f'{RAW[raw]} as "{name}"' for raw, name in columns)
    return f"select {chosen} from registry"


def _read_sql(columns) -> str:
    """The same after a CSV read, where empty fields are null."""
    chosen = ", ".join(f"nullif({RAW[raw]}, '') as \"{name}\"" for raw, name in columns)
    return f"select {chosen} from registry"


def _csv(spark, d, part: str = "true"):
    path = fresh_path(spark, "registry_csv")
    rows = raw_registry(spark, d).filter(part)
    return sink.write_csv(rows, path, encoding="ISO-8859-1")


# --- columns -------------------------------------------------------------------------

ALIASES = ["NOME", "COD_CPF", "nao_existe", "d.cd_ibge", "COD_FAM", "VLR_RENDA_MEDIA"]


def alias_projection(spark, d):
    return col.select_aliases(raw_registry(spark, d), ALIASES)


def alias_projection_inverse(spark, d):
    named = col.select_aliases(raw_registry(spark, d), ["COD_CPF", "NOME", "CEP", "p.grau_instrucao"])
    return col.keep_known_as_raw(named)


def rename_map(spark, d):
    return col.rename_columns(raw_registry(spark, d).select(*[col.quoted(c) for c in REGISTRY_SCAN_COLUMNS]), REGISTRY_RENAMES)


def upper_columns(spark, d):
    return col.upper_columns(view(spark, d, "student").select("matricula", "nm_aluno", "dt_nascimento"))


def drop_columns(spark, d):
    return col.drop_columns(view(spark, d, "manual_roster"), "cpf", "nao_existe")


# --- registry files ------------------------------------------------------------------

def registry_csv_scan(spark, d):
    return registry_csv.scan_registry(spark, _csv(spark, d))


def registry_cached(spark, d):
    table, csv = fresh_path(spark, "registry_table"), _csv(spark, d)
    registry_csv.cached_registry(spark, table, ["/missing/registry.csv", csv])
    # The second call finds the table and does not look for a file.
    return registry_csv.cached_registry(spark, table, [])


def registry_read_version(spark, d):
    return registry_csv.read_registry_version(spark, "agosto", {"agosto": _csv(spark, d)})


def registry_read_all_rows(spark, d):
    path = _csv(spark, d)
    return registry_csv.read_registry_version(spark, path, {}, ["COD_NIS", "COD_CPF", "BAIRRO"], keep_duplicates=True)


def _typed(raw):
    # The social number is unique in the given tables.
    return registry_csv.typed_registry(raw, col.quoted("p.num_nis_pessoa_atual").cast("bigint"))


def registry_typed(spark, d):
    return _typed(registry_csv.read_raw_csv(spark, _csv(spark, d))).select(
        "row_id", "cpf_std", "nome", "cod_fam", "dta_nasc", "cod_parentesco", "renda_media", "dat_atual_fam"
    )


def registry_union_versions(spark, d):
    june = registry_csv.read_raw_csv(spark, _csv(spark, d, "`p.grau_instrucao` <= '5'"))
    august = registry_csv.read_raw_csv(spark, _csv(spark, d, "`p.grau_instrucao` > '5'")).drop("`d.fx_rfpc`")
    wanted = [c for c in august.columns if c != "d.fx_rfpc"]
    both = union_versions(june, august.select(*[col.quoted(c) for c in wanted]))
    return col.select_aliases(both, ["COD_NIS", "COD_CPF", "NOME", "FX_RFPC"])


def header_inspect(spark, d):
    return src.inspect_header(registry_csv.read_raw_csv(spark, _csv(spark, d)), "p.num_nis_pessoa_atual")


def preview_sample(spark, d):
    raw = registry_csv.read_raw_csv(spark, _csv(spark, d))
    return src.preview(col.select_aliases(raw, ["COD_NIS", "COD_CPF", "NOME", "BAIRRO"]), "COD_NIS")


def delimiter_profile(spark, d):
    path = fresh_path(spark, "registry_lines")
    view(spark, d, "registry").select(F.expr(LINE).alias("value")).write.text(path)
    return src.delimiter_profile(src.read_lines(spark, path))


# Detail files of 10,000 orders each with a trailer as last line; every third declares too much.
TRAILER_LINES = """
  select cast(floor(o_orderkey/10000) as bigint) as lote, o_orderkey as ordem, o_custkey as valor,
    concat('D;',cast(o_orderkey as string),';',cast(o_custkey as string)) as value from {orders}"""
TRAILERS = """
  select lote, concat('T;',cast(count(*) + case when lote%3=1 then 1 else 0 end as string),';',
    cast(cast(sum(valor) as bigint) as string)) as value from detail group by lote"""


def _detail_files(spark, d):
    detail = spark.sql(TRAILER_LINES, orders=view(spark, d, "orders"))
    trailer = spark.sql(TRAILERS.replace("from detail", "from {detail}"), detail=detail)
    last = F.lit(2**62)
    lines = detail.select("lote", "ordem", "value").unionByName(trailer.select("lote", last.alias("ordem"), "value"))
    path = fresh_path(spark, "detail_files")
    lines.repartition("lote").sortWithinPartitions("lote", "ordem").drop("ordem").write.partitionBy("lote").text(path)
    return src.read_lines(spark, path)


def _batch():
    return F.regexp_extract("arquivo", "lote=([0-9]+)", 1).cast("bigint").alias("lote")


def trailer_record(spark, d):
    found = src.trailer_records(_detail_files(spark, d))
    return found.select(
        _batch(), "trailer", F.get("campos", F.lit(0)).alias("marca"), F.get("campos", F.lit(1)).alias("linhas"),
        F.get("campos", F.lit(2)).alias("soma"),
    )


def trailer_check(spark, d):
    checked = src.trailer_check(_detail_files(spark, d), "D", value_field=2, count_field=1, sum_field=2)
    return checked.select(_batch(), "linhas", "soma", "linhas_declaradas", "soma_declarada", "confere")


# --- registry files with faulty lines and several layouts ----------------------------

# Every fiftieth line is too long, the next too short, the next has an open quote.
FAULTY = f"""case when row_id%50=1 then concat({LINE},';mais;um') when row_id%50=2 then concat(nis,';',nome,';',nis)
  when row_id%50=3 then concat('"',{LINE}) else {LINE} end"""
FAULT = "case row_id%50 when 1 then 'campos_a_mais' when 2 then 'campos_a_menos' when 3 then 'aspas' end"
FIELDS = f"case row_id%50 when 1 then {len(RAW) + 2} when 2 then 3 end"


# Rows of one written file or one task: more rows make more of them, not larger ones.
PART_ROWS = 250_000


def _faulty_files(spark, d):
    """The registry in four files and one more for each ``PART_ROWS`` rows, each with its header first."""
    people = view(spark, d, "registry")
    files = 4 + people.count() // PART_ROWS
    rows = people.select((F.col("row_id") % files).alias("lote"), F.col("row_id").alias("ordem"), F.expr(FAULTY).alias("value"))
    header = spark.range(files).select(F.col("id").alias("lote"), F.lit(-1).cast("bigint").alias("ordem"), F.lit(";".join(RAW)).alias("value"))
    path = fresh_path(spark, "faulty")
    lines = header.unionByName(rows).repartition("lote").sortWithinPartitions("lote", "ordem").drop("ordem")
    lines.write.partitionBy("lote").option("encoding", "ISO-8859-1").text(path)
    return path


def _divided(spark, d):
    return registry_files.divide_registry(spark, _faulty_files(spark, d), encoding="UTF-8")


def registry_rejects(spark, d):
    return _divided(spark, d).rejects.select("linha", "motivo", "campos")


def registry_accepted(spark, d):
    return registry_csv.typed_registry(_divided(spark, d).rows, col.quoted("p.num_nis_pessoa_atual").cast("bigint")).select(
        "row_id", "cpf_std", "nome", "bairro", "dta_nasc", "renda_media"
    )


def registry_reject_counts(spark, d):
    return _divided(spark, d).counts()


def registry_mixed_headers(spark, d):
    folder, raw = fresh_path(spark, "mixed"), raw_registry(spark, d)
    low, middle, high = (raw.filter(f"`p.grau_instrucao` {part}") for part in ("<= '3'", "between '4' and '6'", "> '6'"))
    sink.write_csv(low, f"{folder}/junho", encoding="ISO-8859-1")
    # one file with its columns the other way round, one without two of them
    sink.write_csv(middle.select(*[col.quoted(c) for c in reversed(raw.columns)]), f"{folder}/julho", encoding="ISO-8859-1")
    sink.write_csv(high.drop("d.fx_rfpc", "p.nom_completo_pai_pessoa"), f"{folder}/agosto", encoding="ISO-8859-1")
    return col.select_aliases(registry_files.divide_registry(spark, folder).rows, ["COD_NIS", "COD_CPF", "NOME", "NOME_PAI", "FX_RFPC", "BAIRRO"])


def registry_row_ids(spark, d):
    """Ids of the same rows, every third of them twice, in two orders and numbers of tasks."""
    raw = raw_registry(spark, d)
    raw = raw.unionByName(raw.filter("cast(`p.num_nis_pessoa_atual` as bigint) % 3 = 0"))
    mixed = raw.repartition(7 + raw.count() // PART_ROWS, F.rand(1))
    one, other = (with_content_ids(df).select("row_id").withColumn("lido", F.lit(n)) for n, df in enumerate((raw, mixed)))
    per_id = one.unionByName(other).groupBy("row_id").agg(F.sum("lido").alias("na_segunda"), F.count(F.lit(1)).alias("vezes"))
    same = (F.col("na_segunda") == 1) & (F.col("vezes") == 2)
    return per_id.agg(F.count(F.lit(1)).alias("ids"), F.count_if(same).alias("iguais"))


def registry_head(spark, d):
    """The first three rows of the first of many files, without reading the others."""
    path = fresh_path(spark, "head")
    raw_registry(spark, d).orderBy(col.quoted("p.num_nis_pessoa_atual")).write.option("sep", ";").option("header", True).option("encoding", "ISO-8859-1").csv(path)
    first = registry_files.list_files(spark, path).filter("bytes > 0").orderBy("arquivo").first().arquivo
    return src.head_rows(spark, first, 3).select("linha", *[col.quoted(c).alias(a) for a, c in HEAD.items()])


def registry_to_month(spark, d):
    """From CSV files over the typed table to the month's metrics."""
    source = _csv(spark, d)
    people = registry_files.build_registry_table(spark, fresh_path(spark, "registry_table"), source)
    tables = {n: view(spark, d, n) for n in MONTH_TABLES if n != "registry"} | {"registry": people}
    paths = publish_month(spark, tables, PERIOD, fresh_path(spark, "month"))
    return spark.read.parquet(paths["metricas"]).drop("mesano")


HEAD = {"nis": "p.num_nis_pessoa_atual", "nome": "p.nom_pessoa", "bairro": "d.nom_localidade_fam", "titulo": "d.nom_titulo_logradouro_fam"}


# --- sinks ---------------------------------------------------------------------------

def _result(spark, d):
    return eligible_registry(spark, d).select(*PERSON)


RESULT_DDL = "row_id bigint, cpf_std string, nome string, dat_atual_fam date, renda_media double"


def sink_csv_roundtrip(spark, d):
    path = sink.write_csv(_result(spark, d), fresh_path(spark, "csv"))
    return spark.read.csv(path, sep=";", header=True, schema=RESULT_DDL)


def sink_parquet_roundtrip(spark, d):
    return spark.read.parquet(sink.write_parquet(_result(spark, d), fresh_path(spark, "parquet")))


def sink_bom_csv(spark, d):
    rows = view(spark, d, "registry").select("row_id", "nome", "bairro")
    path = sink.write_csv(rows, fresh_path(spark, "bom_csv"), bom=True)
    return spark.read.csv(path, sep=";", header=True, schema="row_id bigint, nome string, bairro string")


def sink_multi(spark, d):
    frames = [view(spark, d, "student"), _result(spark, d)]
    paths = sink.write_lists(frames, ["alunos", "elegiveis"], fresh_path(spark, "multi"))
    counts = [
        spark.read.parquet(p).agg(F.count(F.lit(1)).alias("linhas")).select(F.lit(n).alias("tabela"), "linhas")
        for n, p in paths.items()
    ]
    return counts[0].unionByName(counts[1])


def outputs_by_period(spark, d):
    path = fresh_path(spark, "outputs")
    for name in ("previous_accumulated", "current_active"):
        sink.write_period(view(spark, d, name), path)
    # A rerun of one period replaces its rows and leaves the other as it is.
    sink.write_period(view(spark, d, "current_active").withColumn("cpf", F.reverse("cpf")), path)
    in_period = F.col("_metadata.file_path").contains(F.concat(F.lit("mesano="), F.col("mesano").cast("string")))
    return spark.read.parquet(path).select("matricula", "cpf", F.col("mesano").cast("string").alias("mesano"), in_period.cast("int").alias("no_periodo"))


def outputs_listed(spark, d):
    path = fresh_path(spark, "outputs")
    for name in ("previous_accumulated", "current_active"):
        sink.write_period(view(spark, d, name), path)
    listed = [
        sink.outputs_of_period(spark, path, p).agg(F.sum("linhas").alias("linhas")).withColumn("mesano", F.lit(p)) for p in ("202506", "202507")
    ]
    return listed[0].unionByName(listed[1]).select("mesano", "linhas")


def _published(spark, d):
    """A period published with its active and accumulated bases, in a new folder."""
    out, active = fresh_path(spark, "published"), view(spark, d, "current_active")
    publishing.publish_tables(spark, out, PERIOD, {"ativos": active, "acumulada": accumulate(view(spark, d, "previous_accumulated"), active)})
    return out, active


def published_rerun(spark, d):
    out, active = _published(spark, d)
    changed = active.withColumn("cpf", F.reverse("cpf"))
    publishing.publish_tables(spark, out, PERIOD, {"ativos": changed, "acumulada": accumulate(view(spark, d, "previous_accumulated"), changed)})
    publishing.sweep(spark, out, PERIOD)
    names = ("ativos", "acumulada")
    return union_versions(*[publishing.read_published(spark, out, PERIOD, n).withColumn("saida", F.lit(n)) for n in names])


def published_after_failure(spark, d):
    out, active = _published(spark, d)
    changed = active.withColumn("cpf", F.reverse("cpf"))
    broken = changed.withColumn("cpf", F.coalesce(F.raise_error(F.lit("lost")).cast("string"), "cpf"))
    try:
        # the first output of the rerun is written as a whole, the second one fails
        publishing.publish_tables(spark, out, PERIOD, {"ativos": changed, "acumulada": broken})
    except Exception as error:
        if "lost" not in str(error):
            raise
    names = ("ativos", "acumulada")
    return union_versions(*[publishing.read_published(spark, out, PERIOD, n).withColumn("saida", F.lit(n)) for n in names])


# --- jobs ----------------------------------------------------------------------------

MONTH_TABLES = ("enrolment", "school_class", "school_calendar", "school", "student", "registry")


def _month(spark, d):
    out = fresh_path(spark, "month")
    return out, run_month(spark, {n: view(spark, d, n) for n in MONTH_TABLES}, PERIOD, out)


def monthly_metrics(spark, d):
    return _month(spark, d)[1].drop("mesano")


def monthly_outputs(spark, d):
    out, _ = _month(spark, d)
    tables = {n: spark.read.parquet(f"{out}/{n}") for n in ("matriculas", "pessoas_unicas", "nao_mapeados")}
    tables["cpf_invalidos"] = spark.read.csv(f"{out}/cpf_invalidos/{PERIOD}", sep=";", header=True)
    counts = [df.agg(F.count(F.lit(1)).alias("linhas")).select(F.lit(n).alias("saida"), "linhas") for n, df in tables.items()]
    return union_versions(*counts)


def monthly_students(spark, d):
    out, _ = _month(spark, d)
    return spark.read.parquet(f"{out}/matriculas").select("matricula", "cpf_std", "row_id", "nome", "renda_media")


BENEFICIARY_TABLES = ("student", "registry", "enrolment", "school", "school_class", "school_calendar", "manual_roster", "previous_accumulated")


def _beneficiaries(spark, d):
    tables = {n: view(spark, d, n) for n in BENEFICIARY_TABLES}
    return run_beneficiaries(spark, tables, PERIOD, fresh_path(spark, "beneficiaries"))


def beneficiary_outputs(spark, d):
    paths = _beneficiaries(spark, d)
    layout = paths.pop("layout")
    frames = {n: spark.read.parquet(p) for n, p in paths.items()}
    frames["layout"] = spark.read.csv(layout, sep=";", header=True)
    return union_versions(
        *[df.agg(F.count(F.lit(1)).alias("linhas")).select(F.lit(n).alias("saida"), "linhas") for n, df in frames.items()]
    )


def beneficiaries_mapped(spark, d):
    return spark.read.parquet(_beneficiaries(spark, d)["mapeados"])


def beneficiaries_funnel(spark, d):
    return spark.read.parquet(_beneficiaries(spark, d)["funil"])


def beneficiaries_accumulated(spark, d):
    return spark.read.parquet(_beneficiaries(spark, d)["acumulada"]).select("matricula", "cpf", "mesano")


def beneficiaries_layout(spark, d):
    rows = spark.read.csv(_beneficiaries(spark, d)["layout"], sep=";", header=True, escape='"')
    typed = {"MATRICULA": "bigint", "DT_NASC_BENEFICIARIO": "date", "VLR_RENDA_MEDIA": "double"}
    return rows.select(*[F.col(c).cast(typed.get(c, "string")).alias(c) for c in (n.removeprefix("\ufeff") for n in rows.columns)])


def _second_output(layout):
    """An output of another program: some students left out, some with another responsible or income."""
    kept = layout.filter("MATRICULA % 12 <> 0")
    return kept.withColumns({
        "ORIGEM_CPF": F.when(F.col("MATRICULA") % 50 == 1, "RESPONSAVEL").otherwise(F.col("ORIGEM_CPF")),
        "VLR_RENDA_MEDIA": F.when(F.col("MATRICULA") % 35 == 2, F.lit(None)).otherwise(F.col("VLR_RENDA_MEDIA")),
    })


def _analysis(spark, d, output):
    layout, out = settle(beneficiary_layout(spark, d), "layout"), fresh_path(spark, "analysis")
    publish_final_analysis(layout, _second_output(layout), PERIOD, out)
    return publishing.read_published(spark, out, PERIOD, output)


def final_analysis(spark, d):
    return _analysis(spark, d, "resumo")


def final_analysis_columns(spark, d):
    return _analysis(spark, d, "diferencas")


def beneficiary_debug(spark, d):
    matched = settle(waterfall(spark, d).select("matricula", "regra", "cad_row_id"), "matched")
    layout = layout_of(matched, view_registry(spark, d), *views(spark, d, "enrolment", "school"))
    layout = layout.filter("MATRICULA % 12 <> 0")  # students taken out by hand
    return layout_debug(matched, view_registry(spark, d), layout)


def manual_roster_read(spark, d):
    path = sink.write_csv(view(spark, d, "manual_roster"), fresh_path(spark, "manual_roster"))
    return read_manual_roster(spark, path)


def manual_roster_rejected(spark, d):
    shown = F.when(F.col("matricula") % 3 == 0, F.concat(F.lit("M-"), F.col("matricula"))).otherwise(F.col("matricula").cast("string"))
    path = sink.write_csv(view(spark, d, "manual_roster").withColumn("matricula", shown), fresh_path(spark, "manual_roster"))
    return manual_roster_rejects(spark, path)


def registry_incremental(spark, d):
    columns = ["row_id", "cpf", "nome", "dat_atual_fam", "renda_media"]
    source, base, checkpoint = (fresh_path(spark, n) for n in ("arriving", "base", "checkpoint"))
    rows = view(spark, d, "registry").select(*columns, (F.col("row_id") % 3).alias("chegada"))
    schema = "row_id bigint, cpf string, nome string, dat_atual_fam date, renda_media double"
    # Three arrivals; each ingest goes on where the one before ended.
    for arrival in range(3):
        rows.filter(F.col("chegada") == arrival).drop("chegada").write.mode("append").parquet(source)
        incremental.start_ingest(spark, source, schema, base, checkpoint).awaitTermination()
    return incremental.read_base(spark, base).select(*PERSON)


def registry_incremental_buckets(spark, d):
    columns = ["row_id", "cpf", "nome", "dat_atual_fam", "renda_media"]
    source, base, checkpoint = (fresh_path(spark, n) for n in ("arriving", "base", "checkpoint"))
    rows = view(spark, d, "registry").select(*columns, (F.col("row_id") % 3).alias("chegada"))
    schema = "row_id bigint, cpf string, nome string, dat_atual_fam date, renda_media double"
    for arrival in range(3):
        rows.filter(F.col("chegada") == arrival).drop("chegada").write.mode("append").parquet(source)
        bucketed.start_bucket_ingest(spark, source, schema, base, checkpoint, buckets=16).awaitTermination()
    return bucketed.read_buckets(spark, base).select(*PERSON)


def registry_incremental_csv(spark, d):
    source, base, checkpoint = (fresh_path(spark, n) for n in ("arriving_csv", "base", "checkpoint"))
    rows = raw_registry(spark, d)
    for arrival in ("`p.grau_instrucao` <= '4'", "`p.grau_instrucao` > '4'"):
        sink.write_csv(rows.filter(arrival), f"{source}/{'low' if '<=' in arrival else 'high'}", encoding="ISO-8859-1")
    incremental.start_ingest(
        spark, f"{source}/*", rows.schema, base, checkpoint, file_format="csv", prepare=_typed,
        sep=";", header="true", encoding="ISO-8859-1", escape='"',
    ).awaitTermination()
    return incremental.read_base(spark, base).select(*PERSON)


QUERIES = {
    f.__name__: f
    for f in (
        alias_projection, alias_projection_inverse, rename_map, upper_columns, drop_columns,
        registry_csv_scan, registry_cached, registry_read_version, registry_read_all_rows, registry_typed,
        registry_union_versions, registry_rejects, registry_accepted, registry_reject_counts, registry_mixed_headers, registry_row_ids,
        registry_to_month, registry_head, final_analysis, final_analysis_columns, beneficiary_debug, registry_incremental_buckets, header_inspect, preview_sample, delimiter_profile, trailer_record, trailer_check,
        sink_csv_roundtrip, sink_parquet_roundtrip, sink_bom_csv, sink_multi, outputs_by_period, outputs_listed, published_rerun, published_after_failure,
        monthly_metrics, monthly_outputs, monthly_students, beneficiary_outputs, beneficiaries_mapped, beneficiaries_funnel,
        beneficiaries_accumulated, beneficiaries_layout, manual_roster_read, manual_roster_rejected, registry_incremental,
        registry_incremental_csv,
    )
}

SCANNED = [(c, REGISTRY_RENAMES.get(c, c)) for c in REGISTRY_SCAN_COLUMNS]
SCAN_SQL = with_views(
    "registry", _read_sql(SCANNED).replace(" from registry", f', {person()} as "CPF_PADRONIZADO" from registry'))
NUMBERED = ", ".join(f"struct_pack(posicao := {i}, coluna := '{c}', valor := nullif({e}, ''))" for i, (c, e) in enumerate(RAW.items(), 1))
DETAIL = f"detail as ({TRAILER_LINES.replace('{orders}', 'orders')}), trailer as ({TRAILERS})"


MONTH = ctes(
    f"ids as ({STUDENT_SQL['eligible_students']})",
    f"st as (select matricula, nm_aluno, cpf, {person()} as cpf_std from student where matricula in (select matricula from ids))",
    f"er as (select *, {person()} as cpf_std from registry where renda_media<=660)",
)
MONTH_VIEWS = "enrolment school_class school_calendar school student registry"
METRICS_BODY = """select (select count(*) from st) as alunos_total, (select count(cpf_std) from st) as alunos_com_cpf,
  (select count(*) from er) as cad_total, (select count(cpf_std) from er) as cad_com_cpf,
  (select count(*) from st join er on st.cpf_std=er.cpf_std) as merge_linhas,
  (select count(distinct st.cpf_std) from st join er on st.cpf_std=er.cpf_std) as pessoas_unicas"""

def _published_sql(cpf: str) -> str:
    return with_views(
        "previous_accumulated current_active",
        """select 'ativos' as saida, matricula, cpf, mesano from now
          union all select 'acumulada', matricula, cpf, mesano from acc""",
        f"""now as (select matricula, {cpf} as cpf, mesano from current_active),
          acc as (select * from (select *, row_number() over (partition by matricula order by {person()} is null, mesano desc, cpf) as rn
            from (select * from previous_accumulated union all select * from now)) where rn = 1)""")


LAYOUT_SQL = MATCHING_SQL["beneficiary_layout"]
ANALYSIS = ctes(ST, RG, WATERFALL, HEADS, LOCATED, f"""layout as ({LAYOUT_SQL[LAYOUT_SQL.rindex('select wf.matricula as "MATRICULA"'):]}),
  cmp as (select *, case when "MATRICULA" % 12 = 0 then 'only_a' when origin or income then 'differs' else 'same' end as status from (
    select *, "MATRICULA" % 12 <> 0 and "MATRICULA" % 50 = 1 and "ORIGEM_CPF" <> 'RESPONSAVEL' as origin,
      "MATRICULA" % 12 <> 0 and "MATRICULA" % 35 = 2 and "VLR_RENDA_MEDIA" is not null as income from layout))""")


BENEFICIARY_SQL = {
    "mapeados": "select * from mapped",
    "nao_mapeados": "select * from wf where cad_row_id is null",
    "removidas_cpf_duplicado": "select * from gone",
    "acumulada": "select * from acc",
    "inativos": "select * from previous_accumulated where matricula not in (select matricula from mapped)",
    "cpfs_unicos_mapeados": f"select distinct {person()} as p from mapped where p is not null",
    "cpfs_unicos_acumulada": f"select distinct {person()} as p from acc where p is not null",
    "funil": "select 1",  # one row; its contents are in beneficiaries_funnel
    "layout": "select * from wanted join rg on rg.row_id=wanted.cad_row_id and rg.renda_media<=660",
}
ELIGIBLE_ST = f"""ids as ({STUDENT_SQL['eligible_students']}),
  st as (select *, {person()} as cpf_std from student where matricula in (select matricula from ids))"""
BENEFICIARY_CTES = ctes(ELIGIBLE_ST, RG, WATERFALL, LATEST, CONFLICTS, f"""
  gone as (select matricula from cf where nm_aluno<>nome_cad),
  kept as (select * from wf where matricula not in (select matricula from gone)),
  mapped as (select matricula, cpf, origem, '202507' as mesano from (
    select *, row_number() over (partition by matricula order by origem, cpf) as rn from (
      select matricula, cad_cpf as cpf, 'AUTOMATICO' as origem from kept where cad_cpf is not null
      union all select matricula, cpf, 'MANUAL' from manual_roster)) where rn=1),
  acc as (select matricula, cpf, mesano from (
    select *, row_number() over (partition by matricula order by {person()} is null, mesano desc, cpf) as rn
    from (select * from previous_accumulated union all select matricula, cpf, mesano from mapped)) where rn=1),
  manual as (select m.matricula, m.cpf as manual_cpf, latest.row_id from mapped m
    left join latest on latest.cpf_std = {person("m.cpf")} where origem = 'MANUAL'),
  wanted as (select matricula, coalesce(manual.row_id, kept.cad_row_id) as cad_row_id, manual_cpf
    from kept full join manual using (matricula))""")
RUN_LAYOUT = f"""select wanted.matricula as "MATRICULA", coalesce(manual_cpf, rg.cpf_std, heads.cpf_resp) as "COD_CPF", rg.nome as "NOME_BENEFICIARIO",
  rg.dta_nasc as "DT_NASC_BENEFICIARIO", rg.nome_mae as "NOME_MAE_BENEFICIARIO",
  coalesce(located.cd_ibge_escola, rg.cd_ibge) as "COD_MUNIC_IBGE", {ADDRESS} as "ENDERECO", rg.cep as "CEP",
  ddd_contato1||num_tel_contato1 as "TELEFONE_1", ddd_contato2||num_tel_contato2 as "TELEFONE_2",
  cast(null as string) as "EMAIL", rg.renda_media as "VLR_RENDA_MEDIA",
  case when manual_cpf is not null or rg.cpf_std is not null then 'PROPRIO' when cpf_resp is not null then 'RESPONSAVEL'
    else 'NENHUM' end as "ORIGEM_CPF", cpf_resp as "CPF_RESP"
  from wanted join rg on rg.row_id = wanted.cad_row_id and rg.renda_media <= 660
  left join heads on heads.cod_fam = rg.cod_fam left join located on located.matricula = wanted.matricula"""

SQL = {
    "alias_projection": with_views("registry", _raw_sql(
        [(COLUMN_DICTIONARY.get(a, a), a) for a in ALIASES if a != "nao_existe"])),
    "alias_projection_inverse": with_views("registry", _raw_sql(
        [(COLUMN_DICTIONARY[a], COLUMN_DICTIONARY[a]) for a in ("COD_CPF", "NOME", "CEP")])),
    "rename_map": with_views("registry", _raw_sql(SCANNED)),
    "upper_columns": with_views(
        "student", 'select matricula as "MATRICULA", nm_aluno as "NM_ALUNO", dt_nascimento as "DT_NASCIMENTO" from student'),
    "drop_columns": with_views("manual_roster", "select matricula from manual_roster"),
    "registry_csv_scan": SCAN_SQL,
    "registry_cached": SCAN_SQL,
    "registry_read_version": with_views(
        "registry",
        _read_sql([(COLUMN_DICTIONARY[a], a) for a in REGISTRY_DEFAULT_COLUMNS]).replace(" from registry", " from one"),
        f"""one as (select * from (select *, {person()} as cpf_std, row_number() over (partition by {person()}
          order by dat_atual_fam desc, nis) as rn from registry) where cpf_std is null or rn=1)"""),
    "registry_read_all_rows": with_views("registry", _read_sql(
        [(COLUMN_DICTIONARY[a], a) for a in ("COD_NIS", "COD_CPF", "BAIRRO")])),
    "registry_typed": with_views(
        "registry",
        "select row_id, cpf_std, nome, cod_fam, dta_nasc, cod_parentesco, renda_media, dat_atual_fam from rg", RG),
    "registry_union_versions": with_views(
        "registry",
        """select nis as "COD_NIS", nullif(cpf,'') as "COD_CPF", nome as "NOME", case when grau_instrucao<='5' then fx_rfpc end as "FX_RFPC"
          from registry"""),
    "registry_rejects": with_views("registry", f"select {FAULTY} as linha, {FAULT} as motivo, cast({FIELDS} as int) as campos from registry where row_id%50 in (1,2,3)"),
    "registry_accepted": with_views(
        "registry", "select row_id, cpf_std, nome, bairro, dta_nasc, renda_media from rg where row_id%50 not in (1,2,3)", RG),
    "registry_reject_counts": with_views(
        "registry", f"select coalesce({FAULT}, 'aceita') as motivo, count(*) as linhas from registry group by 1"),
    "registry_mixed_headers": with_views(
        "registry",
        """select nis as "COD_NIS", nullif(cpf,'') as "COD_CPF", nome as "NOME", case when grau_instrucao<='6' then nome_pai end as "NOME_PAI",
          case when grau_instrucao<='6' then fx_rfpc end as "FX_RFPC", bairro as "BAIRRO" from registry"""),
    "registry_row_ids": with_views(
        "registry",
        """select count(*) as ids, count(*) as iguais from (select row_id from registry union all
          select row_id from registry where cast(nis as bigint) % 3 = 0)"""),
    "registry_head": with_views(
        "registry",
        """select cast(row_number() over (order by nis) as int) as linha, nis, nome, bairro, titulo_end as titulo from registry order by nis limit 3"""),
    "final_analysis": with_views(
        "student registry enrolment school",
        """select status, count(*) as linhas, round(count(*) / (select count(*) from cmp), 6) as parte from cmp group by status""", ANALYSIS),
    "final_analysis_columns": with_views(
        "student registry enrolment school",
        """select "MATRICULA", 'ORIGEM_CPF' as coluna, "ORIGEM_CPF" as valor_a, 'RESPONSAVEL' as valor_b from cmp where origin
          union all select "MATRICULA", 'VLR_RENDA_MEDIA', cast("VLR_RENDA_MEDIA" as varchar), null from cmp where income""", ANALYSIS),
    "beneficiary_debug": with_views(
        "student registry",
        """select wf.matricula, wf.regra, rg.renda_media as renda, case when wf.regra is null then 'sem_cadastro' when rg.renda_media > 660 then 'renda'
            when wf.matricula % 12 = 0 then 'retirado' else 'no_layout' end as situacao
          from wf left join rg on rg.row_id = wf.cad_row_id""", ctes(ST, RG, WATERFALL)),
    "registry_incremental_buckets": MATCHING_SQL["registry_latest"],
    "registry_to_month": with_views(MONTH_VIEWS, METRICS_BODY, MONTH),
    "header_inspect": with_views(
        "registry",
        f"""select cast(linha as int) as linha, c.posicao, c.coluna, c.valor from (select linha, unnest([{NUMBERED}]) as c from (
          select *, row_number() over (order by nis) as linha from (select * from registry order by nis limit 3)))"""),
    "preview_sample": with_views(
        "registry",
        _read_sql([(COLUMN_DICTIONARY[a], a) for a in ("COD_NIS", "COD_CPF", "NOME", "BAIRRO")]).replace(
            " from registry", ", (select least(200, count(*)) from registry) as linhas_previa from registry")
        + " order by nis limit 5"),
    "delimiter_profile": with_views(
        "registry",
        f"""select delimitador, ocorrencias, cast(ocorrencias = max(ocorrencias) over () as int) as escolhido from (
          select delimitador, cast(sum(len(string_split(linha, delimitador)) - 1) as bigint) as ocorrencias
          from (select {LINE} as linha from registry), (values {", ".join(f"('{c}')" for c in DELIMITERS)}) as d(delimitador)
          group by delimitador)"""),
    "trailer_record": with_views(
        [], """select lote, value as trailer, split_part(value,';',1) as marca, split_part(value,';',2) as linhas,
          split_part(value,';',3) as soma from trailer""", DETAIL),
    "trailer_check": with_views(
        [], """select d.lote, linhas, soma, cast(split_part(t.value,';',2) as bigint) as linhas_declaradas,
          cast(split_part(t.value,';',3) as bigint) as soma_declarada,
          cast(linhas=cast(split_part(t.value,';',2) as bigint) and soma=cast(split_part(t.value,';',3) as bigint) as int) as confere
          from (select lote, count(*) as linhas, cast(sum(valor) as bigint) as soma from detail group by lote) d
          join trailer t on t.lote=d.lote""", DETAIL),
    "sink_csv_roundtrip": MATCHING_SQL["income_filter"],
    "sink_parquet_roundtrip": MATCHING_SQL["income_filter"],
    "sink_bom_csv": with_views("registry", "select row_id, nome, bairro from registry"),
    "sink_multi": with_views(
        "student registry",
        """select 'alunos' as tabela, count(*) as linhas from student
          union all select 'elegiveis', count(*) from registry where renda_media<=660"""),
    "outputs_by_period": with_views(
        "previous_accumulated current_active",
        """select matricula, cpf, mesano, 1 as no_periodo from previous_accumulated
          union all select matricula, reverse(cpf), mesano, 1 from current_active"""),
    "outputs_listed": with_views(
        "previous_accumulated current_active",
        """select '202506' as mesano, count(*) as linhas from previous_accumulated
          union all select '202507', count(*) from current_active"""),
    "published_rerun": _published_sql("reverse(cpf)"),
    "published_after_failure": _published_sql("cpf"),
    "monthly_metrics": with_views(MONTH_VIEWS, METRICS_BODY, MONTH),
    "monthly_outputs": with_views(
        MONTH_VIEWS,
        f"""select 'matriculas' as saida, count(*) as linhas from st where exists (select 1 from er where er.cpf_std=st.cpf_std)
          union all select 'pessoas_unicas', pessoas_unicas from ({METRICS_BODY})
          union all select 'nao_mapeados', count(*) from st where not exists (select 1 from er where er.cpf_std=st.cpf_std)
          union all select 'cpf_invalidos', count(*) from er where cpf_std is null""", MONTH),
    "monthly_students": with_views(
        MONTH_VIEWS,
        """select st.matricula, st.cpf_std, el.row_id, el.nome, el.renda_media from st join (
            select * from er where cpf_std is not null qualify row_number() over (partition by cpf_std order by dat_atual_fam desc, row_id) = 1) el
          on st.cpf_std = el.cpf_std""", MONTH),
    "beneficiaries_funnel": with_views(
        BENEFICIARY_TABLES,
        """select count(*) as lidos, count(wf.cad_row_id) as mapeados, count(*) - count(wf.cad_row_id) as nao_mapeados,
          count(*) filter (rg.renda_media <= 660) as elegiveis, count(wf.cad_row_id) - count(*) filter (rg.renda_media <= 660) as removidos
          from wf left join rg on rg.row_id = wf.cad_row_id""", BENEFICIARY_CTES),
    "beneficiaries_accumulated": with_views(BENEFICIARY_TABLES, "select matricula, cpf, mesano from acc", BENEFICIARY_CTES),
    "beneficiary_outputs": with_views(
        BENEFICIARY_TABLES, "\nunion all ".join(
            f"select '{name}' as saida, count(*) as linhas from ({query})" for name, query in BENEFICIARY_SQL.items()),
        BENEFICIARY_CTES),
    "beneficiaries_mapped": with_views(BENEFICIARY_TABLES, "select matricula, cpf, origem, mesano from mapped", BENEFICIARY_CTES),
    "beneficiaries_layout": with_views(BENEFICIARY_TABLES, RUN_LAYOUT, ctes(BENEFICIARY_CTES, HEADS, LOCATED)),
    "manual_roster_read": with_views("manual_roster", "select * from manual_roster"),
    "manual_roster_rejected": with_views(
        "manual_roster", "select 'M-' || matricula as matricula, cpf from manual_roster where matricula % 3 = 0"),
    "registry_incremental": MATCHING_SQL["registry_latest"],
    "registry_incremental_csv": MATCHING_SQL["registry_latest"],
}

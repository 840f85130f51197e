"""Names and parameters that must equal those of the data the jobs read."""

from __future__ import annotations

# Business alias -> raw column of the registry file.
COLUMN_DICTIONARY = {
    "COD_CPF": "p.num_cpf_pessoa",
    "NOME": "p.nom_pessoa",
    "COD_NIS": "p.num_nis_pessoa_atual",
    "COD_FAM": "d.cod_familiar_fam",
    "DTA_NASC": "p.dta_nasc_pessoa",
    "COD_PARENTESCO": "p.cod_parentesco_rf_pessoa",
    "NOME_MAE": "p.nom_completo_mae_pessoa",
    "NOME_PAI": "p.nom_completo_pai_pessoa",
    "RG": "p.num_identidade_pessoa",
    "VLR_RENDA_MEDIA": "d.vlr_renda_media_fam",
    "VLR_RENDA_TOTAL": "d.vlr_renda_total_fam",
    "IND_PAB": "d.marc_pbf",
    "BAIRRO": "d.nom_localidade_fam",
    "TIPO_END": "d.nom_tip_logradouro_fam",
    "TITULO_END": "d.nom_titulo_logradouro_fam",
    "NOME_END": "d.nom_logradouro_fam",
    "NUM_END": "d.num_logradouro_fam",
    "COMPLEM_1": "d.des_complemento_fam",
    "COMPLEM_2": "d.des_complemento_adic_fam",
    "CEP": "d.num_cep_logradouro_fam",
    "CD_IBGE": "d.cd_ibge",
    "DDD_CONTATO1": "d.num_ddd_contato_1_fam",
    "NUM_TEL_CONTATO1": "d.num_tel_contato_1_fam",
    "DDD_CONTATO2": "d.num_ddd_contato_2_fam",
    "NUM_TEL_CONTATO2": "d.num_tel_contato_2_fam",
    "FX_RFPC": "d.fx_rfpc",
    "NOME_PESSOA": "p.nom_pessoa",
    "VLR_RENDA_MEDIA_FAM": "d.vlr_renda_media_fam",
    "VLR_RENDA_TOTAL_FAM": "d.vlr_renda_total_fam",
    "COD_FAMILIAR_FAM": "d.cod_familiar_fam",
    "IND_PBF": "d.marc_pbf",
    "COD_INEP": "d.cd_ibge",
}

# Raw columns a registry scan keeps.
REGISTRY_SCAN_COLUMNS = [
    "d.cd_ibge",
    "d.cod_familiar_fam",
    "d.nom_localidade_fam",
    "d.nom_tip_logradouro_fam",
    "d.nom_titulo_logradouro_fam",
    "d.nom_logradouro_fam",
    "d.num_logradouro_fam",
    "d.des_complemento_fam",
    "d.des_complemento_adic_fam",
    "d.num_cep_logradouro_fam",
    "d.vlr_renda_media_fam",
    "d.fx_rfpc",
    "d.vlr_renda_total_fam",
    "d.marc_pbf",
    "d.num_ddd_contato_1_fam",
    "d.num_tel_contato_1_fam",
    "d.num_ddd_contato_2_fam",
    "d.num_tel_contato_2_fam",
    "p.nom_pessoa",
    "p.num_nis_pessoa_atual",
    "p.dta_nasc_pessoa",
    "p.num_cpf_pessoa",
    "p.cod_parentesco_rf_pessoa",
    "p.grau_instrucao",
]

# Raw column -> name in the cached registry table.
REGISTRY_RENAMES = {
    "p.num_cpf_pessoa": "CPF_CADUNICO",
    "p.nom_pessoa": "NOME_PESSOA_CADUNICO",
    "p.dta_nasc_pessoa": "DATA_NASC_CADUNICO",
    "d.vlr_renda_media_fam": "RENDA_MEDIA_FAM",
    "d.vlr_renda_total_fam": "RENDA_TOTAL_FAM",
    "d.marc_pbf": "IND_PAB_FAM",
    "d.num_cep_logradouro_fam": "CEP",
    "d.cod_familiar_fam": "COD_FAMILIAR",
}

# Columns a versioned registry read returns by default.
REGISTRY_DEFAULT_COLUMNS = [
    "COD_CPF", "NOME", "COD_NIS", "COD_FAM", "DTA_NASC",
    "COD_PARENTESCO", "NOME_MAE", "NOME_PAI", "RG", "VLR_RENDA_MEDIA",
]

# The enrolment fact's columns in the wide student extract.
ENROLMENT_FACT_COLUMNS = [
    "ano_base", "data_referencia", "idt_estab", "nro_int_curso", "nro_int_turma",
    "cd_turma", "cd_turma_normalizado", "chave_contagem_turma", "chave_tpo_ensino",
    "turno", "in_bolsa_familia", "in_tjne", "cd_sexo", "ds_raca",
    "in_autodeclarado_quilombola", "idade", "nro_int_neces_esp",
    "idade_inicial_serie", "idade_final_serie", "in_distorcao_idade",
    "chave_contagem_matricula", "chave_contagem_aluno",
]

# Columns of the student document extract.
DOCUMENT_COLUMNS = [
    "nro_int_aluno_estado", "nm_aluno_puro", "dt_nascimento", "cpf", "cpf_pai",
    "cpf_mae", "cpf_responsavel", "nm_mae_puro", "nr_ident_mae", "nm_pai_puro",
    "nr_ident_pai", "nr_doc_mae", "nr_doc_pai",
]

# Rule parameters.
HIGH_SCHOOL_TYPES = ("R2", "I2", "E2")
AGE_LIMITS = {"I2": 21, "E2": 21, "R2": 21, "S2": 29, "E9": 29}
ACTIVE_SITUATIONS = (1, 8)
ACTIVE_SITUATION_NAMES = ("Matriculado", "Infrequente")
EXCLUDED_DESIGNATIONS = (10, 489)
INCOME_CUT = 660.0
DELIMITERS = (",", ";", "|", "\t")

"""DuckDB oracle SQL for every query key (registered beside its builder).

Each text is the two stand-in views as CTEs followed by an independent SQL
formulation of the query.  Doubles are rounded to 6 places, counts cast to
BIGINT and years to INT on both sides before comparison.
"""

from __future__ import annotations

RAW_MATCHES = """
raw_matches AS (
SELECT l_orderkey AS cod_imovel, l_linenumber AS linha, l_partkey AS id_parte, l_suppkey AS id_vizinhanca,
       c_custkey AS idt_municipio, right(c_name, 3) AS municipio_nome, n_name AS estado, r_name AS regiao,
       o_orderstatus AS status_imovel, p_type AS tipo_imovel, p_size AS num_modulo,
       CASE WHEN l_linenumber = 6 THEN '31/12/1999' ELSE CAST(CAST(o_orderdate AS date) AS string) END AS data_cadastro_imovel,
       l_extendedprice AS area_a, CASE WHEN l_tax = 0.08 AND l_linenumber = 5 THEN 0.0 ELSE l_quantity * p_retailprice END AS area_b,
       CASE WHEN l_linenumber = 7 THEN NULL ELSE least(l_extendedprice, l_quantity * p_retailprice) / greatest(l_extendedprice, l_quantity * p_retailprice) END AS indice,
       CASE WHEN l_tax = 0.07 THEN NULL WHEN l_linestatus = 'O' THEN (CASE WHEN l_tax < 0.03 THEN 'true' ELSE '1' END) ELSE 'False' END AS igualdade_txt,
       (c_nationkey = s_nationkey) AS dono_igual
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
)"""

MATCHES = """
matches AS (
SELECT *, CASE WHEN lower(igualdade_txt) IN ('true','1','t') THEN 1 ELSE 0 END AS cpf_ok,
       CASE WHEN lower(igualdade_txt) IN ('true','1','t') THEN 'Igual' ELSE 'Diferente' END AS label_cpf,
       CAST(year(try_cast(data_cadastro_imovel AS date)) AS int) AS ano_cadastro,
       CASE WHEN indice >= 0 AND indice < 0.25 THEN '0-25%' WHEN indice >= 0.25 AND indice < 0.50 THEN '25-50%'
            WHEN indice >= 0.50 AND indice < 0.85 THEN '50-85%' WHEN indice >= 0.85 AND indice <= 1.00 THEN '85-100%' END AS faixa_jaccard,
       CASE WHEN round(CAST(num_modulo AS DECIMAL(20,6)), 4) <= 4 THEN 'Pequeno' WHEN round(CAST(num_modulo AS DECIMAL(20,6)), 4) <= 15 THEN 'Médio' ELSE 'Grande' END AS class_tam_imovel,
       ((area_a - area_b) / nullif(area_b, 0)) * 100 AS discrepancia
FROM raw_matches
)"""

PREFIX = "WITH" + RAW_MATCHES + "," + MATCHES + "\n"


def with_views(body: str, extra_ctes: str = "") -> str:
    """Prefix the two views (and optional extra CTEs) to a query body."""
    if extra_ctes:
        return PREFIX.rstrip() + ",\n" + extra_ctes.strip() + "\n" + body
    return PREFIX + body

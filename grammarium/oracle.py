"""SQL fragments that the DuckDB versions of several queries share."""

BLANKS_SQL = r"E' \t\r'"


def rules_sql(source: str, key: str) -> str:
    """CTEs lines, ruled, latest, alts, members over source(key, minimal_grammar): alts has places and repeats, members is distinct."""
    return rf"""
lines AS (SELECT {key} AS id, i, trim(line, {BLANKS_SQL}) AS line FROM (SELECT {key}, unnest(string_split(minimal_grammar, E'\n')) AS line, generate_subscripts(string_split(minimal_grammar, E'\n'), 1) AS i FROM {source})),
ruled AS (SELECT id, i, trim(split_part(line, '::=', 1), {BLANKS_SQL}) AS name, substr(line, instr(line, '::=') + 3) AS rhs FROM lines WHERE contains(line, '::=')),
latest AS (SELECT id, name, max(i) AS rule_pos, arg_max(rhs, i) AS rhs FROM ruled GROUP BY id, name),
alts AS (SELECT id, name, rule_pos, alt_pos, trim(a, {BLANKS_SQL}) AS alt FROM (SELECT id, name, rule_pos, unnest(string_split(rhs, ' | ')) AS a, generate_subscripts(string_split(rhs, ' | '), 1) AS alt_pos FROM latest) WHERE trim(a, {BLANKS_SQL}) <> ''),
members AS (SELECT DISTINCT id, name, alt FROM alts)"""


def one_per(table: str, key: str) -> str:
    return f"(SELECT DISTINCT ON ({key}) * FROM {table} WHERE {key} IS NOT NULL)"

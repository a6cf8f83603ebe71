"""DuckDB SQL for the training-data operators that SQL can express."""

from .reputation import TWO_LABEL_SUFFIXES

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP1 = f"""
WITH slim AS (
  SELECT doc_id, source, CAST(len({WORDS}) AS BIGINT) AS size,
    CAST('0x' || substr(md5(concat_ws('|', coalesce(CAST(doc_id AS VARCHAR), ''), md5(coalesce(text, '')))), 1, 12) AS BIGINT) AS h
  FROM documents),
sizes AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS k FROM slim GROUP BY source),
weighed AS (
  SELECT source, source_size, CAST(CASE (k - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS DOUBLE) AS weight, 2.0::DOUBLE * source_size AS lim FROM sizes),
levels AS (
  SELECT *, lim / weight AS ratio,
    (1.5::DOUBLE * (SELECT sum(source_size) FROM sizes) - coalesce(sum(lim) OVER w, 0)) / ((SELECT sum(weight) FROM weighed) - coalesce(sum(weight) OVER w, 0)) AS level
  FROM weighed WINDOW w AS (ORDER BY lim / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
settled AS (SELECT arg_min(level, ratio) AS level FROM levels WHERE level * weight < lim),
targets AS (
  SELECT source, source_size, CASE WHEN s.level IS NULL THEN lim ELSE least(lim, s.level * weight) END AS target FROM levels l CROSS JOIN settled s),
budgets AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS copies FROM targets),
summed AS (
  SELECT doc_id, size, b.source_size, b.target, copies, target - copies * b.source_size AS room,
    sum(size) OVER (PARTITION BY b.source ORDER BY h, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
  FROM slim JOIN budgets b ON slim.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, source_size, target, CAST(size * (copies + CASE WHEN upto - size / 2 <= room THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM summed
"""

ORACLES: dict[str, str] = {"op1_mixing": OP1}

#: Beta-binomial moments of one level, as in reputation.host_reputation.
_LEVEL = """
{name}_sum AS (
  SELECT count(*) AS k, sum(n) * 1.0::DOUBLE AS n, sum(good) * 1.0::DOUBLE AS good, sum(n * n) * 1.0::DOUBLE AS sq, sum(good * good * 1.0::DOUBLE / n) AS spread, sum(good) * 1.0::DOUBLE / sum(n) AS p
  FROM {name}),
{name}_spread AS (SELECT p, k, spread - 2 * p * good + p * p * n AS between, p * (1 - p) * (n - sq / n - (k - 1)) AS room FROM {name}_sum),
{name}_fit AS (
  SELECT p, (1 - r) / r AS strength FROM (
    SELECT p, least(greatest(CASE WHEN room > 0 THEN (between - p * (1 - p) * (k - 1)) / room ELSE 0.001 END, 0.001), 0.9) AS r FROM {name}_spread)),
"""

_SUFFIXES = ", ".join(f"'{x}'" for x in TWO_LABEL_SUFFIXES)

OP6 = (
    r"""
WITH parsed AS (
  SELECT page_id,
    translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 2, 's'), '') AS path
  FROM pages),
all_hosts AS (
  SELECT host, array_to_string(list_slice(string_split(host, '.'), -2, -1), '.') IN (""" + _SUFFIXES + r""") AS two,
    count(quality) AS n, sum(CASE WHEN quality = 1 AND coalesce(toxic, 0) <> 1 THEN 1 ELSE 0 END) AS good
  FROM parsed LEFT JOIN labels ON page_id = doc_id GROUP BY host),
named AS (
  SELECT host, n, good, array_to_string(list_slice(string_split(host, '.'), CASE WHEN two THEN -3 ELSE -2 END, -1), '.') AS domain,
    array_to_string(list_slice(string_split(host, '.'), CASE WHEN two THEN -2 ELSE -1 END, -1), '.') AS suffix
  FROM all_hosts),
hosts AS (SELECT * FROM named WHERE n > 0),
domains AS (SELECT domain, suffix, sum(n) AS n, sum(good) AS good FROM hosts GROUP BY domain, suffix),
suffixes AS (SELECT suffix, sum(n) AS n, sum(good) AS good FROM domains GROUP BY suffix),
"""
    + "".join(_LEVEL.format(name=x) for x in ("hosts", "domains", "suffixes"))
    + """
suffix_mean AS (SELECT suffix, (good + f.p * f.strength) / (n + f.strength) AS m FROM suffixes, suffixes_fit f),
domain_mean AS (SELECT domain, (good + s.m * f.strength) / (n + f.strength) AS m FROM domains d JOIN suffix_mean s ON d.suffix = s.suffix, domains_fit f),
means AS (
  SELECT host, (good + coalesce(d.m, s.m, (SELECT p FROM suffixes_fit)) * f.strength) / (n + f.strength) AS m, n + f.strength AS total
  FROM named h LEFT JOIN domain_mean d ON h.domain = d.domain LEFT JOIN suffix_mean s ON h.suffix = s.suffix, hosts_fit f),
bounds AS (SELECT host, m + 1.645 * sqrt(m * (1 - m) / (total + 1)) AS high FROM means),
rules(rule_host, rule_path, says) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
fitting AS (
  SELECT page_id, host, path, max_by(rule_host || rule_path, length(rule_host || rule_path)) AS rule, max_by(says, length(rule_host || rule_path)) AS says
  FROM parsed JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY ALL)
SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.says, CASE WHEN b.high < 0.5 THEN 'block' ELSE 'allow' END) AS verdict
FROM parsed p
LEFT JOIN (SELECT DISTINCT host, path, rule, says FROM fitting) f ON p.host = f.host AND p.path = f.path
LEFT JOIN bounds b ON p.host = b.host
"""
)

ORACLES["op6_url_filter"] = OP6

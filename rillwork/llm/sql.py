"""DuckDB SQL for the registered queries that SQL can express."""

HOST_REPUTATION = r"""
WITH parts AS (
    SELECT page_id,
           translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
           coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path
    FROM pages),
names AS (
    SELECT host, CASE WHEN regexp_matches(name, '^(\[.*|[0-9]{1,3}(\.[0-9]{1,3}){3})$') THEN name
                      ELSE array_to_string(list_slice(string_split(name, '.'), -2, -1), '.') END AS domain,
           CASE WHEN regexp_matches(name, '^(\[.*|[0-9]{1,3}(\.[0-9]{1,3}){3})$') THEN name ELSE list_extract(string_split(name, '.'), -1) END AS suffix
    FROM (SELECT DISTINCT host, regexp_extract(host, '(?s)^(?:.*@)?(\[[^\]]*\]|[^:]*)', 1) AS name FROM parts)),
outcomes AS (
    SELECT p.host, CASE WHEN l.toxic = 1 OR l.quality = 0 THEN 1 ELSE 0 END AS bad
    FROM parts p JOIN labels l ON l.doc_id = p.page_id
    WHERE l.toxic IS NOT NULL OR l.quality IS NOT NULL),
host_counts AS (
    SELECT host, domain, suffix, count(*) AS n, sum(bad)::BIGINT AS bad
    FROM outcomes JOIN names USING (host) GROUP BY host, domain, suffix),
domain_counts AS (SELECT domain, suffix, sum(n)::BIGINT AS n, sum(bad)::BIGINT AS bad FROM host_counts GROUP BY domain, suffix),
suffix_counts AS (SELECT suffix, sum(n)::BIGINT AS n, sum(bad)::BIGINT AS bad FROM host_counts GROUP BY suffix),
grouped AS (
    SELECT 'host' AS level, n, bad FROM host_counts UNION ALL
    SELECT 'domain', n, bad FROM domain_counts UNION ALL
    SELECT 'suffix', n, bad FROM suffix_counts),
totals AS (
    SELECT level, sum(n)::DOUBLE AS pages, sum(bad)::DOUBLE AS bads, count(*) AS k, sum(n::DOUBLE * n) AS squares,
           sum(bad::DOUBLE * bad / n) AS spread, (sum(bad) + 0.5::DOUBLE) / (sum(n) + 1.0::DOUBLE) AS rate
    FROM grouped GROUP BY level),
spreads AS (
    SELECT level, rate, (spread - bads * bads / pages - (k - 1) * (rate * (1 - rate)))
                        / CASE WHEN pages - squares / pages > 0 THEN pages - squares / pages END AS between_groups
    FROM totals),
weights AS (
    SELECT level, rate, greatest(1.0::DOUBLE, least(10000.0::DOUBLE,
           CASE WHEN between_groups > 0 THEN rate * (1 - rate) / between_groups - 1 ELSE 10000.0::DOUBLE END)) AS weight
    FROM spreads),
suffix_means AS (
    SELECT s.suffix, (s.bad + w.weight * w.rate) / (s.n + w.weight) AS m
    FROM suffix_counts s JOIN weights w ON w.level = 'suffix'),
domain_means AS (
    SELECT d.domain, (d.bad + w.weight * s.m) / (d.n + w.weight) AS m
    FROM domain_counts d JOIN suffix_means s USING (suffix) JOIN weights w ON w.level = 'domain'),
host_means AS (
    SELECT h.host, (h.bad + w.weight * d.m) / (h.n + w.weight) AS m, h.n + w.weight AS size
    FROM host_counts h JOIN domain_means d USING (domain) JOIN weights w ON w.level = 'host'
    UNION ALL
    SELECT x.host, coalesce(d.m, s.m, w.rate), w.weight
    FROM (SELECT * FROM names WHERE host NOT IN (SELECT host FROM host_counts)) x
    JOIN weights w ON w.level = 'host' LEFT JOIN domain_means d USING (domain) LEFT JOIN suffix_means s ON s.suffix = x.suffix),
bounds AS (SELECT host, round(m - 1.64::DOUBLE * sqrt(m * (1 - m) / (size + 1)), 6) AS bound FROM host_means),
rules(kind, rule, rule_host, rule_path) AS (
    VALUES ('block', 'net/', 'net', '/'), ('allow', 'example.net/en/', 'example.net', '/en/'),
           ('block', 'example.com/de/', 'example.com', '/de/'), ('allow', 'org/fr/', 'org', '/fr/')),
ruled AS (
    SELECT h.host, h.path, arg_max(r.rule, length(r.rule)) AS rule, arg_max(r.kind, length(r.rule)) AS kind
    FROM (SELECT DISTINCT host, path FROM parts) h
    JOIN rules r ON (h.host = r.rule_host OR ends_with(h.host, '.' || r.rule_host)) AND starts_with(h.path, r.rule_path)
    GROUP BY h.host, h.path)
SELECT p.page_id, p.host, p.path, r.rule,
       coalesce(r.kind, CASE WHEN b.bound > 0.35::DOUBLE THEN 'block' ELSE 'allow' END) AS verdict, b.bound
FROM parts p LEFT JOIN ruled r ON r.host = p.host AND r.path = p.path LEFT JOIN bounds b ON b.host = p.host
"""


def merkle_proofs(levels: int = 8) -> str:
    """Trees of up to 16**levels leaves, a step per level. A tree that is down to one node stays as it is."""
    # crc32 of a number's decimal text, bit by bit; 3988292384 is the reversed polynomial.
    byte_step = "list_reduce(list_prepend(xor(acc, b), range(8)), lambda v, i: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END)"
    digits = "list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: ascii(c)::BIGINT)"
    crc = f"xor(list_reduce(list_prepend(4294967295::BIGINT, {digits}), lambda acc, b: {byte_step}), 4294967295)"

    def row_hash(text: str) -> str:
        values = ["CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)", text]
        return "sha256(" + " || ".join(f"coalesce(strlen({v}) || ':' || {v}, '-')" for v in values) + ")"

    small = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    steps = [f"""
    hashed AS (SELECT doc_id, source, {row_hash("text")} AS leaf,
        CASE WHEN doc_id IS NOT NULL AND {crc} % 5 = 0 THEN {row_hash(small)} ELSE {row_hash("text")} END AS now FROM documents),
    docs AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS spot FROM hashed),
    g0 AS (SELECT source AS tree, spot, leaf AS h, count(*) OVER (PARTITION BY source) AS w FROM docs)"""]

    def climb(name: str) -> list[str]:
        return [
            f"""{name}{i}r AS (SELECT tree, spot // 16 AS run, list(h ORDER BY spot) AS hs, any_value(w) AS w FROM {name}{i} GROUP BY tree, spot // 16),
    {name}{i + 1} AS (SELECT tree, run AS spot, CASE WHEN w > 1 THEN sha256(array_to_string(hs, '')) ELSE hs[1] END AS h, (w + 15) // 16 AS w FROM {name}{i}r)"""
            for i in range(levels)
        ]

    def walk(begin: str, name: str, of: str) -> list[str]:
        return [
            f"""{name}p{i + 1} AS (SELECT p.* EXCLUDE (spot, node, proof), p.spot // 16 AS spot,
        CASE WHEN w > 1 THEN sha256(array_to_string(hs[1:p.spot % 16], '') || node || array_to_string(hs[p.spot % 16 + 2:], '')) ELSE node END AS node,
        CASE WHEN w > 1 THEN proof || array_to_string(hs[1:p.spot % 16], '') || array_to_string(hs[p.spot % 16 + 2:], '') ELSE proof END AS proof
        FROM {f"{name}p{i}" if i else begin} p JOIN {name}{i}r r ON r.tree IS NOT DISTINCT FROM {of} AND r.run = p.spot // 16)"""
            for i in range(levels)
        ]

    steps += climb("g")
    steps.append(f"t0 AS (SELECT 'all' AS tree, row_number() OVER (ORDER BY tree NULLS FIRST) - 1 AS spot, h, count(*) OVER () AS w, tree AS source FROM g{levels})")
    steps += climb("t")
    steps.append("begun AS (SELECT doc_id, source, leaf, spot, now AS node, '' AS proof FROM docs)")
    steps += walk("begun", "g", "p.source")
    steps.append(f"""placed AS (SELECT p.doc_id, p.leaf, t0.h AS subroot, t0.spot, p.node, p.proof
        FROM gp{levels} p JOIN t0 ON t0.source IS NOT DISTINCT FROM p.source)""")
    steps += walk("placed", "t", "'all'")
    return "WITH " + ",\n    ".join(steps) + f"""
    SELECT doc_id, leaf, subroot, t.h AS root, sha256(proof) AS proof_sha256, node AS folded_root, node = t.h AS verified FROM tp{levels}, t{levels} t"""


MERKLE_PROOFS = merkle_proofs()

"""SQL for DuckDB that states results of these operators in another way."""

from __future__ import annotations


def crc32(text: str) -> str:
    """Unsigned CRC-32 of a text's UTF-8 bytes, one bit at a time: a byte is mixed in, then eight shifts follow it."""
    code = f"hex(encode({text}))"
    steps = f"flatten(list_transform(range(0, length({code}) // 2), lambda i: list_concat([('0x' || substr({code}, 2 * i + 1, 2))::BIGINT], [-1, -1, -1, -1, -1, -1, -1, -1])))"
    step = "CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, 3988292384 * (c & 1)) END"
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], {steps}), lambda c, x: {step}), 4294967295)"


def merkle(levels: int = 8, every: int = 5) -> str:
    """The manifest by one query a level: runs of 16, in which a node sees the digests before and after it."""
    field = lambda e: f"coalesce(strlen(CAST({e} AS VARCHAR)) || ':' || CAST({e} AS VARCHAR), '-')"
    capitals = "".join(map(chr, range(65, 91)))
    leaf = lambda text: "sha256(" + " || ".join(field(e) for e in ("doc_id", "source", "lang", "n_chars", text)) + ")"
    out = [f"""WITH given AS (
  SELECT *, coalesce('.' || source, '-') AS g, {leaf("text")} AS leaf, {leaf(f"translate(text, '{capitals}', '{capitals.lower()}')")} AS lowered,
    doc_id IS NOT NULL AND {crc32("CAST(doc_id AS VARCHAR)")} % {every} = 0 AS touched
  FROM documents),
base AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM given),
a0 AS (SELECT g, pos, leaf AS d, count(*) OVER (PARTITION BY g) AS n FROM base)"""]

    def tree(name: str) -> None:
        for k in range(levels):
            out.append(f"""{name}{k}s AS (SELECT g, pos, n, d,
  coalesce(string_agg(d, '') OVER (PARTITION BY g, pos // 16 ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
  coalesce(string_agg(d, '') OVER (PARTITION BY g, pos // 16 ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM {name}{k})""")
            out.append(f"""{name}{k + 1} AS (SELECT g, pos // 16 AS pos, CASE WHEN n > 1 THEN sha256(string_agg(d, '' ORDER BY pos)) ELSE first(d) END AS d,
  (n + 15) // 16 AS n FROM {name}{k} GROUP BY g, pos // 16, n)""")

    tree("a")
    out.append(f"b0 AS (SELECT 'all' AS g, row_number() OVER (ORDER BY g) - 1 AS pos, d, count(*) OVER () AS n, g AS of FROM a{levels})")
    tree("b")
    out.append("f0 AS (SELECT b.doc_id, b.g, b.pos, b.leaf, CASE WHEN touched THEN lowered ELSE leaf END AS f, '' AS p FROM base b)")
    for k in range(levels):
        out.append(f"""f{k + 1} AS (SELECT f.doc_id, f.g, f.pos, f.leaf, CASE WHEN s.n > 1 THEN sha256(s.l || f.f || s.r) ELSE f.f END AS f, f.p || s.l || s.r AS p
  FROM f{k} f JOIN a{k}s s ON s.g = f.g AND s.pos = f.pos // {16 ** k})""")
    out.append(f"h0 AS (SELECT f.doc_id, f.leaf, b.d AS subroot, b.pos, f.f, f.p FROM f{levels} f JOIN b0 b ON b.of = f.g)")
    for k in range(levels):
        out.append(f"""h{k + 1} AS (SELECT f.doc_id, f.leaf, f.subroot, f.pos, CASE WHEN s.n > 1 THEN sha256(s.l || f.f || s.r) ELSE f.f END AS f, f.p || s.l || s.r AS p
  FROM h{k} f JOIN b{k}s s ON s.pos = f.pos // {16 ** k})""")
    return ",\n".join(out) + f"""
SELECT h.doc_id, h.leaf, h.subroot, t.d AS root, sha256(h.p) AS proof_sha256, h.f AS folded_root, h.f = t.d AS verified
FROM h{levels} h CROSS JOIN b{levels} t"""


def repeated_windows(window: int = 50) -> str:
    """Every window laid out, and the least document of each; removal is judged word by word."""
    return f"""WITH given AS (
  SELECT row_number() OVER () AS k, doc_id, coalesce(doc_id, 9223372036854775807) AS place,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w
  FROM documents),
starts AS (SELECT k, place, w, unnest(range(1, len(w) - {window} + 2)) AS p FROM given),
windows AS (SELECT k, place, p, md5(array_to_string(w[p:p + {window - 1}], ' ')) AS key FROM starts),
late AS (SELECT k, p FROM (SELECT k, p, place, min(place) OVER (PARTITION BY key) AS least FROM windows) WHERE least < place),
gone AS (SELECT DISTINCT k, p + o AS spot FROM late CROSS JOIN (SELECT unnest(range(0, {window})) AS o)),
words AS (SELECT k, unnest(w) AS word, generate_subscripts(w, 1) AS spot FROM given),
kept AS (SELECT k, string_agg(word, ' ' ORDER BY spot) AS text FROM words ANTI JOIN gone USING (k, spot) GROUP BY k),
cut AS (SELECT k, count(*) AS n FROM gone GROUP BY k)
SELECT g.doc_id, len(g.w)::BIGINT AS n_words, coalesce(c.n, 0)::BIGINT AS n_removed, sha256(coalesce(t.text, '')) AS kept_sha256
FROM given g LEFT JOIN kept t USING (k) LEFT JOIN cut c USING (k)"""


def spelling(least_length: int = 7, least_count: int = 2, noise: int = 31, times: int = 10) -> str:
    """Near words meet where one letter is left out: at the same place for a replacement, or in the other word itself."""
    capitals = "".join(map(chr, range(65, 91)))
    return f"""WITH RECURSIVE runs AS (
  SELECT id, translate(run, '{capitals}', '{capitals.lower()}') AS run, count(*) AS n
  FROM (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, unnest(regexp_extract_all(text, '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')) AS run FROM documents)
  WHERE length(run) >= {least_length} GROUP BY ALL),
hashed AS (SELECT run, n, {crc32("id || ':' || run")} AS h FROM runs),
cut AS (SELECT CASE WHEN h % {noise} = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed),
words AS (SELECT word, sum(n)::BIGINT AS n FROM cut WHERE length(word) >= {least_length} GROUP BY word HAVING sum(n) >= {least_count}),
places AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS p FROM words),
less AS (SELECT word, n, p, substr(word, 1, p - 1) || substr(word, p + 1) AS rest FROM places),
near AS (
  SELECT a.word, b.word AS other, b.n FROM less a JOIN less b ON a.rest = b.rest AND a.p = b.p AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM words a JOIN less b ON a.word = b.rest
  UNION SELECT a.word, b.word, b.n FROM less a JOIN words b ON a.rest = b.word),
best AS (SELECT word, count(*) AS n_near, first(other ORDER BY n DESC, other) AS other, max(n) AS other_n FROM near GROUP BY word),
known AS (
  SELECT w.word, w.n, coalesce(b.n_near, 0)::BIGINT AS n_near, CASE WHEN b.other_n >= {times} * w.n THEN b.other END AS form,
    CASE WHEN b.other_n >= {times} * w.n THEN b.other_n END AS form_n
  FROM words w LEFT JOIN best b USING (word)),
way AS (
  SELECT word, word AS root, form AS next FROM known
  UNION ALL SELECT w.word, k.word, k.form FROM way w JOIN known k ON k.word = w.next)
SELECT k.word, k.form, w.root, k.n, k.n_near, k.form_n FROM known k JOIN way w ON w.word = k.word AND w.next IS NULL"""

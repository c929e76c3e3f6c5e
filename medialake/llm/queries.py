"""Queries over the test tables for the training-data operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from medialake.llm import bpe, decontaminate, langid, licenses, lm, merkle, mixing, quality, repair, rules, sharding, simhash, topics, toxicity
from medialake.llm.common import id_fold, materialise, table


def op4_decontaminate(spark, sf_dir):
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_simhash(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def _learnt(spark, sf_dir, label, folds, held):
    """Documents to learn from, none of the held-out fold, and the labels."""
    docs = table(spark, sf_dir, "documents").where(id_fold("doc_id", folds) != held)
    return docs.select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", label)


def op1_lm(spark, sf_dir):
    return lm.score(table(spark, sf_dir, "documents"))


def op2_quality(spark, sf_dir):
    model = quality.fit(*_learnt(spark, sf_dir, "quality", 4, 2))
    docs = table(spark, sf_dir, "documents").withColumn("held_out", id_fold("doc_id", 4) == 2)
    return quality.score(docs, model, ["doc_id", "held_out"])


def op3_sharding(spark, sf_dir):
    placed = sharding.shard(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return placed.select("doc_id", "size", "text_crc32", "law", "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_mixing(spark, sf_dir):
    placed = mixing.described_by_all(table(spark, sf_dir, "documents"), keep=["doc_id"])
    found = mixing.calibrated(placed, mixing.plan(placed))
    return found.select("row.doc_id", F.col("d0").alias("source"), F.col("d1").alias("lang"), F.col("d2").alias("topic"), F.col("tokens").alias("n_tokens"), F.col("p").alias("probability"), "kept")


def op6_langid(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(id_fold("doc_id", 3) != 1))
    return langid.identify(docs.withColumn("held_out", id_fold("doc_id", 3) == 1), model, ["doc_id", "held_out"])


def with_paths(docs):
    """Documents as files of a tree: source / package / part; every tenth is a licence file."""
    up = F.concat_ws("/", F.col("source"), F.concat(F.lit("pkg"), F.col("doc_id") % 7))
    part = F.concat(F.lit("part"), F.floor(F.col("doc_id") / 7) % 5)
    path = F.when(F.col("doc_id") % 20 == 0, F.concat_ws("/", up, F.concat(F.lit("LICENSE.d"), "doc_id"))).when(F.col("doc_id") % 10 == 0, F.concat_ws("/", up, part, F.concat(F.lit("LICENSE.d"), "doc_id"))).otherwise(F.concat_ws("/", up, part, F.concat("doc_id", F.lit(".txt"))))
    return docs.withColumn("path", path)


def op7_licenses(spark, sf_dir):
    return licenses.scan(with_paths(table(spark, sf_dir, "documents")))


def _values(rows):
    quote = lambda x: "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x)
    return ", ".join("(" + ", ".join(map(quote, r)) + ")" for r in rows)


def op8_toxicity(spark, sf_dir):
    model = toxicity.fit(*_learnt(spark, sf_dir, "toxic", 3, 1))
    docs = table(spark, sf_dir, "documents").withColumn("held_out", id_fold("doc_id", 3) == 1)
    return quality.score(docs, model, ["doc_id", "held_out"], neutral=0.0)


def op10_rules(spark, sf_dir):
    return rules.judge(table(spark, sf_dir, "documents"), rules.fit(*_learnt(spark, sf_dir, "quality", 4, 2)))


def op11_repair(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    damaged = repair.damage(rows)
    found = repair.repair(damaged)
    of = lambda df: df.withColumnRenamed("conv", "_conv")
    own, same = rows.select("conv_id").distinct(), F.col("conv_id").eqNullSafe(F.col("_conv"))
    for part in (repair.gaps(damaged), found.summary, repair.digests(found.turns)):
        own = own.join(of(part), same, "left").drop("_conv")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return own.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", F.sha2(F.lit(b""), 256)).alias("repaired_sha256"))


def _repair_sql():
    """Cheapest repair from each row on and after each initial read so far, (cost, audit, text), from the last row back."""
    after = [2, 2, 3, 2]
    keeps = [{"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2}]
    role = lambda to: "user" if to == 2 else "assistant"
    step = lambda b, cost, letter, line: f"{{'c': {b}.c + {cost}, 'a': '{letter}' || {b}.a, 't': " + (f"{line} || CASE WHEN {b}.t = '' THEN '' ELSE chr(10) || {b}.t END" if line else f"{b}.t") + "}"
    taken = []
    for q in range(4):
        own = [step(f"b[{q + 1}]", 4, "D", "")]
        own.append(f"CASE WHEN stays THEN {step(f'b[{after[q] + 1}]', '3 + cut', 'R', chr(39) + role(after[q]) + ':' + chr(39) + ' || text')} END")
        own += [f"CASE WHEN stays AND left(role, 1) = '{i}' THEN {step(f'b[{to + 1}]', 'cut', 'K', chr(34) + 'role' + chr(34) + ' || ' + chr(39) + ':' + chr(39) + ' || text')} END" for i, to in keeps[q].items()]
        taken.append(f"list_min([{', '.join(own)}])")
    inserted = []
    for q in range(4):
        best, lines, node = [f"x[{q + 1}]"], [], q
        for m in range(1, 4):
            node = after[node]
            lines.append(f"{role(node)}:")
            best.append(step(f"x[{node + 1}]", 3 * m, "I" * m, "'" + "' || chr(10) || '".join(lines) + "'"))
        inserted.append(f"list_min([{', '.join(best)}])")
    none = "{'c': 1000000000::BIGINT, 'a': '', 't': ''}"
    full = "{'c': 0::BIGINT, 'a': '', 't': ''}"
    closed = f"[{', '.join(inserted)}]"
    return f"""
WITH RECURSIVE raw AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_crc32_sql("(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))")} % 20 AS k FROM conversations),
hurt AS (SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role, CASE k WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE WHEN k = 3 THEN 2 ELSE 1 END)) AS copy FROM raw WHERE k <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), copy) AS i, regexp_replace(text, '[\\x20\\x09-\\x0D]+$', '') AS bare FROM hurt),
faults AS (SELECT *, bare = '' AS blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again, right(bare, 1) NOT IN ('.', '!', '?') AS open_end,
  lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) AS pair FROM placed),
rows_in AS (SELECT conv_id, i, role, text, NOT blank AND NOT again AS stays, CASE WHEN open_end THEN 3 ELSE 0 END AS cut FROM faults),
counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (again AND NOT blank) AS duplicate,
  count(*) FILTER (open_end AND NOT blank AND NOT again) AS truncated, count(*) FILTER (pair IS NOT NULL AND pair NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n FROM faults GROUP BY conv_id),
best(conv_id, i, b) AS (
  SELECT conv_id, n, {closed} FROM (SELECT conv_id, n, [{full}, {none}, {none}, {full}] AS x FROM counts)
  UNION ALL SELECT conv_id, i, {closed} FROM (SELECT best.conv_id, best.i - 1 AS i, [{', '.join(taken)}] AS x FROM best JOIN rows_in r ON r.conv_id IS NOT DISTINCT FROM best.conv_id AND r.i = best.i)),
done AS (SELECT conv_id, b[1] AS x FROM best WHERE i = 0)
SELECT d.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(x.c, 0) AS cost, coalesce(x.a, '') AS audit, sha256(coalesce(x.t, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) d LEFT JOIN counts ON counts.conv_id IS NOT DISTINCT FROM d.conv_id LEFT JOIN done ON done.conv_id IS NOT DISTINCT FROM d.conv_id"""


def op12_bpe(spark, sf_dir, tokenizer=None):
    """``tokenizer``: path of a byte-level tokenizer file, by default that of the public one."""
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    vocabulary = bpe.read_vocabulary(tokenizer)
    found = bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary, decoded_col="decoded")
    listed = F.array_join(F.col("ids").cast("array<string>"), ",")
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(listed.cast("binary"), 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op13_merkle(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = merkle.manifest(docs, changed=merkle.tampered(docs))
    return found.select("doc_id", "leaf", "subroot", "root", merkle.digest(F.col("proof")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def _crc32_sql(text):
    """Unsigned crc32 of ASCII text, bit by bit."""
    byte = "list_reduce([xor(c, b)] || [0::UBIGINT, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384::UBIGINT * (x & 1)))"
    return f"xor(list_reduce([4294967295::UBIGINT] || list_transform(string_split({text}, ''), lambda b: ascii(b)::UBIGINT), lambda c, b: {byte}), 4294967295::UBIGINT)"


def _merkle_sql(levels=12, over=4):
    """One step of the tree, and of the folding, for each level that there may be."""
    leaf = lambda text: "sha256(concat(" + ", ".join(f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}::VARCHAR) || ':' || {c} END" for c in ("doc_id", "source", "lang", "n_chars", text)) + "))"
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    with_slot = "left(pre, 64 * s) || {own} || substr(pre, 64 * s + 65)"
    steps = [
        f"d AS (SELECT doc_id, lang, {leaf('text')} AS leaf, CASE WHEN {_crc32_sql('doc_id::VARCHAR')} % 3 = 0 THEN {leaf(lower)} END AS other FROM documents)",
        "n0 AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM d)",
        "t0 AS (SELECT lang, i, n, leaf AS h FROM n0)",
    ]
    for k in range(1, levels + 1):
        steps += [f"p{k} AS (SELECT lang, i // 8 AS i, (any_value(n) + 7) // 8 AS n, string_agg(h, '' ORDER BY t{k - 1}.i) AS pre FROM t{k - 1} WHERE n > 1 GROUP BY lang, i // 8)", f"t{k} AS (SELECT lang, i, n, sha256(pre) AS h FROM p{k})"]
    steps += ["subs AS (" + " UNION ALL ".join(f"SELECT lang, h FROM t{k} WHERE n = 1" for k in range(levels + 1)) + ")", "u0 AS (SELECT lang, h, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM subs)"]
    for k in range(1, over + 1):
        steps += [f"q{k} AS (SELECT i // 8 AS i, (any_value(n) + 7) // 8 AS n, string_agg(h, '' ORDER BY u{k - 1}.i) AS pre FROM u{k - 1} WHERE n > 1 GROUP BY i // 8)", f"u{k} AS (SELECT i, n, sha256(pre) AS h FROM q{k})"]
    steps += ["tops AS (" + " UNION ALL ".join(f"SELECT h AS root FROM u{k} WHERE n = 1" for k in range(over + 1)) + ")", "f0 AS (SELECT doc_id, lang, leaf, i, coalesce(other, leaf) AS cur, '' AS sib FROM n0)"]
    columns, fold = "doc_id, {g}, leaf, {i}", f"CASE WHEN pre IS NULL THEN cur ELSE sha256({with_slot.format(own='cur')}) END AS cur, sib || coalesce({with_slot.format(own=repr(''))}, '') AS sib"
    for k in range(1, levels + 1):
        steps.append(f"f{k} AS (SELECT {columns.format(g='f.lang', i='f.i')}, {fold} FROM (SELECT *, (i // {8 ** (k - 1)}) % 8 AS s FROM f{k - 1}) f LEFT JOIN p{k} p ON f.lang IS NOT DISTINCT FROM p.lang AND p.i = f.i // {8**k})")
    steps.append(f"g0 AS (SELECT doc_id, leaf, u.h AS subroot, u.i, cur, sib FROM f{levels} f JOIN u0 u ON f.lang IS NOT DISTINCT FROM u.lang)")
    for k in range(1, over + 1):
        steps.append(f"g{k} AS (SELECT {columns.format(g='subroot', i='f.i')}, {fold} FROM (SELECT *, (i // {8 ** (k - 1)}) % 8 AS s FROM g{k - 1}) f LEFT JOIN q{k} p ON p.i = f.i // {8**k})")
    return "WITH " + ",\n".join(steps) + f"\nSELECT doc_id, leaf, subroot, root, sha256(sib) AS proof_sha256, cur AS folded_root, cur = root AS verified FROM g{over}, tops"


QUERIES = {
    "op1_lm": op1_lm,
    "op2_quality": op2_quality,
    "op3_sharding": op3_sharding,
    "op4_decontaminate": op4_decontaminate,
    "op5_mixing": op5_mixing,
    "op6_langid": op6_langid,
    "op7_licenses": op7_licenses,
    "op8_toxicity": op8_toxicity,
    "op9_simhash": op9_simhash,
    "op10_rules": op10_rules,
    "op11_repair": op11_repair,
    "op12_bpe": op12_bpe,
    "op13_merkle": op13_merkle,
}

ORACLE_SQL = {
    "op7_licenses": f"""
WITH f AS (SELECT doc_id, coalesce(text, '') AS text, concat_ws('/', source, 'pkg' || doc_id % 7) AS up, 'part' || (doc_id // 7) % 5 AS part FROM documents),
p AS (SELECT doc_id, text, doc_id % 10 = 0 AS is_file, CASE WHEN doc_id % 20 = 0 THEN up ELSE up || '/' || part END AS dir,
  CASE WHEN doc_id % 20 = 0 THEN up || '/LICENSE.d' || doc_id WHEN doc_id % 10 = 0 THEN up || '/' || part || '/LICENSE.d' || doc_id ELSE up || '/' || part || '/' || doc_id || '.txt' END AS path FROM f),
t(template, license, body, needs, bars) AS (VALUES {_values([(i, a, b, " ".join(licenses.needs(a, b)), " ".join(licenses.bars(b))) for i, (a, b) in enumerate(licenses.TEMPLATES)])}),
tw AS (SELECT template, license, unnest(regexp_extract_all(lower(body), '[a-z0-9]+')) AS w FROM t),
vocab AS (SELECT DISTINCT w FROM tw),
df AS (SELECT w, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM p) JOIN vocab USING (w) GROUP BY w),
idf AS (SELECT w, ln((1 + (SELECT count(*) FROM p)) / (1 + coalesce(n, 0))::DOUBLE) + 1 AS idf FROM vocab LEFT JOIN df USING (w)),
tv AS (SELECT template, license, w, count(*) * any_value(idf) AS y FROM tw JOIN idf USING (w) GROUP BY ALL),
tn AS (SELECT template, license, w, y / sqrt(sum(y * y) OVER (PARTITION BY template)) AS x FROM tv),
units AS (SELECT doc_id, i, s[i] AS line FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS i FROM (SELECT doc_id, CASE WHEN is_file THEN list_append(string_split(text, chr(10)), text) ELSE string_split(text, chr(10)) END AS s FROM (SELECT doc_id, is_file, regexp_replace(text, '{licenses.NOTICE}', '\\1', 'g') AS text FROM p)))),
uw AS (SELECT doc_id, i, w, count(*) * coalesce(any_value(idf), (SELECT ln((1 + count(*)) / 2.0) + 1 FROM p)) AS y FROM (SELECT doc_id, i, unnest(regexp_extract_all(lower(line), '[a-z0-9]+')) AS w FROM units) LEFT JOIN idf USING (w) GROUP BY doc_id, i, w),
un AS (SELECT doc_id, i, w, y / sqrt(sum(y * y) OVER (PARTITION BY doc_id, i)) AS y FROM uw),
cos AS (SELECT doc_id, i, template, license, round(sum(x * y), 9) AS c FROM un JOIN tn USING (w) GROUP BY ALL),
sizes AS (SELECT template, count(*) AS n FROM tw GROUP BY template),
held AS (SELECT doc_id, i, list(w) AS ws FROM uw GROUP BY doc_id, i),
unit AS (SELECT doc_id, cos.license, c, n FROM cos JOIN sizes USING (template) JOIN t USING (template) JOIN held USING (doc_id, i)
  WHERE c >= 0.75 AND (needs = '' OR list_has_all(ws, string_split(needs, ' '))) AND NOT list_has_any(ws, string_split(bars, ' ')) QUALIFY row_number() OVER (PARTITION BY doc_id, i ORDER BY c DESC, cos.license, n DESC) = 1),
own AS (SELECT doc_id, license, c AS cosine FROM unit QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY CASE WHEN c >= 0.9 THEN -n ELSE 0 END, c DESC, license) = 1),
holders AS (SELECT dir AS license_dir, license, cosine FROM p JOIN own USING (doc_id) WHERE is_file QUALIFY row_number() OVER (PARTITION BY dir ORDER BY cosine DESC, license) = 1),
near AS (SELECT doc_id, h.* FROM p JOIN holders h ON dir = license_dir OR starts_with(dir, license_dir || '/') QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY length(license_dir) DESC) = 1)
SELECT doc_id, path, coalesce(own.license, near.license) AS license, coalesce(own.cosine, near.cosine) AS cosine,
  CASE WHEN own.license IS NOT NULL THEN 'own' WHEN near.license IS NOT NULL THEN 'inherited' END AS origin,
  CASE WHEN own.license IS NULL THEN near.license_dir END AS license_dir
FROM p LEFT JOIN own USING (doc_id) LEFT JOIN near USING (doc_id)""",
    "op4_decontaminate": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT item_id, least(len(w), 10) AS n, unnest([array_to_string(w[i:i + 9], ' ') FOR i IN range(1, greatest(2, len(w) - 8))]) AS win FROM b WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS win FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
hit AS (SELECT doc_id, i, dw.n, item_id FROM dw JOIN bw USING (n, win)),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS list FROM hit GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(list, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op11_repair": _repair_sql(),
    "op13_merkle": _merkle_sql(),
}

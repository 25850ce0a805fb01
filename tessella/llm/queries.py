"""Queries opN_<name> over the whole tables, and their SQL where there is any."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, codes, decontam, licenses, mixing, ngram_join, pieces, quality, substring, topk, toxicity, trie, urls
from .common import forget, staged, table


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(spark, table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(spark, table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return substring.remove_repeats(spark, docs).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.grade_toxicity(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.rank_quality(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(spark, table(spark, sf_dir, "embeddings"), "vec_id % 20 = 0", k=20, scale=64.0)


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: Conversation -1: texts that look like another template's marks.
FORGED = [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    forged = spark.createDataFrame(FORGED, "conv_id long, turn long, role string, text string")
    chats = chat.format_chats(rows.unionByName(forged))
    turns = chat.read_turns(F.col("formatted"))
    said = F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = chat.read_loss(F.col("formatted"), F.col("loss_mask"))
    read = chats.select("conv_id", F.size(turns).cast("long").alias("n_turns"), said.alias("said"), loss.alias("loss"), F.length("formatted").cast("long").alias("formatted_chars"))
    return read.select("conv_id", "n_turns", F.sha2(F.encode("said", "UTF-8"), 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.encode("loss", "UTF-8"), 256).alias("loss_sha256"), "formatted_chars")


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(table(spark, sf_dir, "pages"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = trie.numbered(spark, table(spark, sf_dir, "conversations"))
    lengths = turns.groupBy("conv_id").agg(F.max("pos").alias("length"))
    shared = (F.crc32(F.encode(F.col("conv_id").cast("string"), "UTF-8")) % 9).alias("h")
    plans = lengths.select("conv_id", (F.col("conv_id") - F.col("conv_id") % 5).alias("base"), shared)
    plans = plans.join(lengths.withColumnsRenamed({"conv_id": "base", "length": "there"}), "base", "left")
    plans = staged(spark, plans.select("conv_id", "base", "h", F.least("h", F.coalesce("there", F.lit(0))).alias("taken")), "plans")
    own = turns.join(plans.select("conv_id", "h", "taken"), "conv_id").where("pos > h").withColumn("pos", F.col("pos") - F.col("h") + F.col("taken"))
    # A conversation lends its first eight turns to at most five.
    heads = turns.where("pos <= 8").withColumnRenamed("conv_id", "base").join(plans.select("conv_id", "base", "taken"), "base").where("pos <= taken")
    rebuilt = staged(spark, own.select(*turns.columns).unionByName(heads.select(*turns.columns)), "rebuilt")
    nodes = trie.build(spark, rebuilt, plans)
    forget(spark, turns, plans, rebuilt)
    return nodes


def op12_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    model = public_tokenizers.path("piece_bpe_32k.model")
    read = pieces.round_trip(spark, table(spark, sf_dir, "documents").select("doc_id", "text"), model)
    said = F.expr("replace(trim(BOTH '[]' FROM cast(ids AS string)), ', ', ',')")
    return read.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(said, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = codes.compress(spark, table(spark, sf_dir, "embeddings"), parts=16, entries=64, rounds=2, scale=256.0)
    code = F.array_join(F.transform("codes", lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))), "")
    return codes.with_label_errors(coded).select("vec_id", code.alias("code"), "error", "label_error", F.lit(codes.digest(books)).alias("codebooks_sha256"))


QUERIES = {f.__name__: f for f in (op1_mix_sources, op2_ngram_jaccard, op3_substring_dedup, op4_toxicity, op5_quality, op6_exact_top_k, op7_license_scan, op8_decontaminate, op9_chat_format, op10_url_filter, op11_prefix_trie, op12_sentencepiece, op13_vector_codes)}

#: Words of a text column; the class is the complement of 0x20 and 0x09-0x0D.
_WORDS = r"regexp_extract_all(coalesce({}, ''), '[^\x20\x09-\x0D]+')"
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TEMPLATES = " UNION ALL ".join(f"SELECT '{name}' AS license, {licenses.bigrams_of(text)} AS t" for name, text in licenses.TEMPLATES)


def _picked(mask: str, words: str, start: str) -> str:
    return " || ' ' || ".join(f"{words}[{start} + {i + 1}]" for i, c in enumerate(mask) if c == "1")


def _vector_codes(rounds: int = 2) -> str:
    """Parts as lists of integers, codebooks round by round."""

    def nearest(k: int) -> str:
        return f"""
        a{k} AS (
          SELECT u, p, x, d AS error, e FROM (
            SELECT v.u, v.p, v.x, c.e, list_sum(list_transform(list_zip(v.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d,
              row_number() OVER (PARTITION BY v.u, v.p ORDER BY d, c.e) AS k FROM v JOIN c{k} c USING (p)) WHERE k = 1)"""

    steps = []
    for k in range(rounds):
        steps.append(nearest(k))
        steps.append(f"""
        m{k} AS (SELECT p, e, list(m ORDER BY i) AS x FROM (
          SELECT p, e, i, CAST(floor_div(sum(v), count(*)) AS BIGINT) AS m FROM (SELECT p, e, unnest(x) AS v, unnest(range(len(x))) AS i FROM a{k}) GROUP BY p, e, i) GROUP BY p, e),
        c{k + 1} AS (SELECT p, e, coalesce(m.x, c.x) AS x FROM c{k} c LEFT JOIN m{k} m USING (p, e))""".replace("floor_div(sum(v), count(*))", "(sum(v) - ((sum(v) % count(*)) + count(*)) % count(*)) // count(*)"))
    return f"""
        WITH q AS (
          SELECT row_number() OVER () AS u, vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
          FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        v AS (SELECT u, p, q[p * w + 1:(p + 1) * w] AS x FROM (SELECT u, q, len(q) // 16 AS w, unnest(range(16)) AS p FROM q)),
        o AS (SELECT u, row_number() OVER (ORDER BY vec_id NULLS LAST, q) - 1 AS e FROM q),
        c0 AS (SELECT p, e, x FROM v JOIN o USING (u) WHERE e < 64),{",".join(steps)},{nearest(rounds)},
        r AS (SELECT u, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(error) AS BIGINT) AS error FROM a{rounds} GROUP BY u),
        h AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM c{rounds})
        SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM r JOIN q USING (u), h"""


def _seeds(source: str, key: str, spaced: str, short: str) -> str:
    """Rows (key, mask, p, seed): p is where the mask is laid, from 0. spaced and short: which rows the masks are for, and which the runs of k words."""
    masks = (f"SELECT {key}, {m} AS mask, p, {_picked(mask, 'ws', 'p')} AS seed FROM (SELECT {key}, ws, unnest(range(0, len(ws) - {len(mask)} + 1)) AS p FROM {source} WHERE {spaced})" for m, mask in enumerate(decontam.COVER))
    runs = f"SELECT {key}, -k AS mask, p, array_to_string(ws[p + 1:p + k], ' ') AS seed FROM (SELECT {key}, ws, k, unnest(range(0, len(ws) - k + 1)) AS p FROM {source} JOIN short ON {short})"
    return " UNION ALL ".join([*masks, runs])


ORACLE_SQL = {
    "op1_mix_sources": f"""
        WITH d AS (SELECT doc_id, source, len({_WORDS.format("text")}) AS size FROM documents),
        b AS (SELECT CAST(sum(size) AS DOUBLE) AS budget FROM d),
        t AS (
          SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source COLLATE "C" NULLS LAST) - 1 AS s FROM d GROUP BY source),
        c AS (SELECT *, CAST(1 + s % 3 AS DOUBLE) AS weight, 3 * source_size / CAST(1 + s % 3 AS DOUBLE) AS cap FROM t),
        f AS (
          SELECT *, (budget - coalesce(CAST(sum(3 * source_size) OVER (ORDER BY cap, s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS DOUBLE), 0))
            / sum(weight) OVER (ORDER BY cap, s ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
          FROM c, b),
        l AS (SELECT coalesce((SELECT level FROM f WHERE level <= cap ORDER BY cap, s LIMIT 1), (SELECT level FROM f ORDER BY cap DESC, s DESC LIMIT 1)) AS level),
        q AS (
          SELECT d.doc_id, d.size, c.s, c.source_size, c.weight, least(3.0 * c.source_size, c.weight * l.level) AS target,
            CAST(sum(d.size) OVER (PARTITION BY c.s ORDER BY md5('20:' || coalesce(CAST(d.doc_id AS VARCHAR), '')), d.doc_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS sent
          FROM d JOIN c ON d.source IS NOT DISTINCT FROM c.source, l),
        x AS (SELECT *, (turn * source_size + sent) / weight AS finish FROM q, (SELECT unnest([0, 1, 2]) AS turn) WHERE size > 0),
        m AS (SELECT *, sum(size) OVER (ORDER BY finish, s, turn ROWS UNBOUNDED PRECEDING) AS total FROM x),
        k AS (SELECT s, sent, CAST(sum(size) AS BIGINT) AS taken FROM m, b WHERE total <= budget GROUP BY s, sent)
        SELECT q.doc_id, CAST(q.size AS BIGINT) AS size, q.source_size, q.target, CASE WHEN q.size > 0 THEN coalesce(k.taken, 0) ELSE 0 END AS taken
        FROM q LEFT JOIN k ON q.s = k.s AND q.sent = k.sent""",
    "op2_ngram_jaccard": f"""
        WITH RECURSIVE w AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS.format(_LOWER)} AS ws FROM documents),
        s AS (
          SELECT DISTINCT r, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
            ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS g FROM w),
        n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
        p AS (SELECT a.r AS x, b.r AS y, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.r <> b.r GROUP BY a.r, b.r),
        links AS (SELECT x, y FROM p JOIN n nx ON nx.r = x JOIN n ny ON ny.r = y WHERE 100 * i >= 75 * (nx.n + ny.n - i)),
        reach AS (SELECT r AS root, r FROM w UNION SELECT root, y FROM reach JOIN links ON x = reach.r),
        c AS (SELECT root, min(doc_id) AS component_id FROM reach JOIN w USING (r) GROUP BY root)
        SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id FROM w JOIN c ON c.root = w.r LEFT JOIN n USING (r)""",
    "op3_substring_dedup": f"""
        WITH w AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS.format("text")} AS ws FROM documents),
        win AS (SELECT r, p, array_to_string(ws[p:p + 34], ' ') AS g FROM (SELECT r, ws, unnest(range(1, len(ws) - 33)) AS p FROM w WHERE len(ws) >= 35)),
        again AS (SELECT g FROM win GROUP BY g HAVING count(*) > 1),
        gone AS (SELECT DISTINCT r, unnest(range(p, p + 35)) AS i FROM win SEMI JOIN again USING (g)),
        word AS (SELECT r, unnest(ws) AS v, unnest(range(1, len(ws) + 1)) AS i FROM w),
        kept AS (
          SELECT r, count(*) AS n, count(gone.i) AS m, string_agg(v, ' ' ORDER BY word.i) FILTER (gone.i IS NULL) AS t
          FROM word LEFT JOIN gone USING (r, i) GROUP BY r)
        SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_words, CAST(coalesce(m, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
        FROM w LEFT JOIN kept USING (r)""",
    "op7_license_scan": f"""
        WITH t AS ({_TEMPLATES}),
        l AS (
          SELECT doc_id, string_split(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9\n]+', ' ', 'g'), chr(10)) AS lines FROM documents),
        u AS (
          SELECT row_number() OVER () AS u, doc_id, line_no, list_filter(string_split(line, ' '), lambda x: x <> '') AS ws
          FROM (
            SELECT doc_id, unnest(range(0, len(lines))) AS line_no, unnest(lines) AS line FROM l
            UNION ALL SELECT doc_id, -1, array_to_string(lines, ' ') FROM l WHERE len(lines) > 1)),
        g AS (SELECT u, doc_id, line_no, list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) AS g FROM u WHERE len(ws) > 1),
        d AS (SELECT u, doc_id, line_no, license, 2.0::DOUBLE * len(list_intersect(g, t)) / (len(g) + len(t)) AS dice FROM g, t),
        b AS (SELECT *, row_number() OVER (PARTITION BY u ORDER BY dice DESC, license) AS k FROM d WHERE dice >= {licenses.THRESHOLD})
        SELECT doc_id, CAST(line_no AS BIGINT) AS line_no, license, round(dice, 6) AS dice FROM b WHERE k = 1""",
    "op8_decontaminate": f"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS ws FROM documents),
        b AS (SELECT row_number() OVER () AS j, item_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS ws FROM benchmark),
        short AS (SELECT DISTINCT len(ws) AS k FROM b WHERE len(ws) BETWEEN 1 AND {decontam.SHORTEST - 1}),
        ds AS ({_seeds("d", "r", f"len(ws) >= {decontam.SHORTEST}", "len(ws) >= k")}), bs AS ({_seeds("b", "j", f"len(ws) >= {decontam.SHORTEST}", "len(ws) = k")}),
        hit AS (SELECT DISTINCT r, j, ds.p AS p, bs.p AS q FROM ds JOIN bs USING (mask, seed)),
        al AS (
          SELECT r, j, p, q, len(b.ws) AS m, list_transform(list_filter(range(-15, 30), lambda k: q + k >= 0 AND q + k < len(b.ws) AND p + k >= 0 AND p + k < len(d.ws)),
            lambda k: CAST(b.ws[q + k + 1] = d.ws[p + k + 1] AS INTEGER)) AS e
          FROM hit JOIN d USING (r) JOIN b USING (j)),
        best AS (SELECT r, j, m, len(e) AS n, list_max(list_transform(range(1, greatest(len(e) - 14, 1) + 1), lambda s: list_sum(e[s:s + 14]))) AS agree FROM al)
        SELECT doc_id, item_id, CAST(max(agree) AS BIGINT) AS agree FROM best JOIN d USING (r) JOIN b USING (j)
        WHERE CASE WHEN m < {decontam.SHORTEST} THEN agree = m ELSE n >= {decontam.SHORTEST} AND agree >= least(n, 15) - 2 END GROUP BY doc_id, item_id""",
    "op6_exact_top_k": """
        WITH v AS (
          SELECT row_number() OVER () AS row_id, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
          FROM embeddings
          WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (
          SELECT a.row_id, a.vec_id AS query_id, b.vec_id, CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])) AS BIGINT) AS score
          FROM v a JOIN v b ON a.row_id <> b.row_id WHERE a.vec_id % 20 = 0),
        r AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY score DESC, vec_id) AS rank FROM s)
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20""",
    "op11_prefix_trie": """
        WITH t AS (
          SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos
          FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)),
        n AS (SELECT conv_id, max(pos) AS length FROM t GROUP BY conv_id),
        crc AS (
          SELECT conv_id, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
            lambda c, b: list_reduce(list_prepend(xor(c, b), list_transform(range(8), lambda i: CAST(i AS BIGINT))), lambda x, i: xor(x >> 1, (x & 1) * 3988292384))), 4294967295) % 9 AS h
          FROM n),
        p AS (SELECT crc.conv_id, crc.conv_id - crc.conv_id % 5 AS base, h, least(h, coalesce(b.length, 0)) AS taken FROM crc LEFT JOIN n b ON b.conv_id = crc.conv_id - crc.conv_id % 5),
        r AS (
          SELECT conv_id, pos - h + taken AS pos, role, text FROM t JOIN p USING (conv_id) WHERE pos > h
          UNION ALL SELECT p.conv_id, pos, role, text FROM p JOIN t ON t.conv_id = p.base WHERE pos <= taken),
        k AS (
          SELECT conv_id, pos AS depth, strlen(text) AS bytes, string_agg(sha256(role || chr(10) || sha256(text)), '' ORDER BY pos) OVER (PARTITION BY conv_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS prefix FROM r
          UNION ALL SELECT conv_id, 0, 0, '' FROM p),
        node AS (SELECT depth, prefix, min(conv_id) AS conv_id, count(*) AS n_convs, max(bytes) AS bytes FROM k GROUP BY depth, prefix),
        own AS (SELECT k.conv_id, k.depth, k.prefix, node.conv_id AS owner, max(k.depth) OVER (PARTITION BY k.conv_id) AS length FROM k JOIN node USING (depth, prefix)),
        above AS (SELECT depth, prefix, min(up) AS parent_conv_id FROM (SELECT depth, prefix, lag(owner) OVER (PARTITION BY conv_id ORDER BY depth) AS up FROM own) GROUP BY depth, prefix),
        kids AS (SELECT node.depth - 1 AS depth, left(prefix, 64 * (node.depth - 1)) AS prefix, count(*) AS n_children FROM node WHERE depth > 0 GROUP BY 1, 2),
        sub AS (
          SELECT a.depth, a.prefix, sum(CASE WHEN kids.n_children IS NULL THEN 1 ELSE 0 END) AS n_leaves, sum((b.n_convs - 1) * b.bytes) AS saved_tokens
          FROM node b LEFT JOIN kids USING (depth, prefix) JOIN own a ON a.conv_id = b.conv_id AND a.depth <= b.depth GROUP BY a.depth, a.prefix),
        e AS (SELECT depth, prefix, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) AS ids FROM own WHERE depth = length GROUP BY depth, prefix)
        SELECT node.conv_id, CAST(depth AS BIGINT) AS depth, parent_conv_id, n_convs, coalesce(n_children, 0) AS n_children, CAST(n_leaves AS BIGINT) AS n_leaves,
          CAST(saved_tokens AS BIGINT) AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
        FROM node JOIN above USING (depth, prefix) JOIN sub USING (depth, prefix) LEFT JOIN kids USING (depth, prefix) LEFT JOIN e USING (depth, prefix)""",
    "op13_vector_codes": _vector_codes(),
    "op9_chat_format": r"""
        WITH rows AS (
          SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
          UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
        cut AS (
          SELECT *, row_number() OVER w AS k, lag(role) OVER w IS DISTINCT FROM role OR row_number() OVER w = 1 AS opens
          FROM rows WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
        sized AS (
          SELECT *, length(text) + 4 * (length(text) - length(replace(text, '&', ''))) + 3 * (length(text) - length(replace(text, '<', '')))
            + 5 * (length(text) - length(replace(text, '[', '')))
            + CASE WHEN opens THEN 13 + length(role) + 4 * (length(role) - length(replace(role, '&', ''))) + 3 * (length(role) - length(replace(role, '<', '')))
                + 5 * (length(role) - length(replace(role, '[', ''))) ELSE 5 END AS chars
          FROM cut)
        SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
          CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
          sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
          CAST(sum(chars) AS BIGINT) AS formatted_chars
        FROM sized GROUP BY conv_id""",
}

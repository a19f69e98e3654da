"""The queries opN_<name>: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigscan.llm import chatformat, langid, mixing, quality, tokencount, toxicity
from sigscan.llm.common import crc_mod
from sigscan.llm.convrepair import repair_damaged
from sigscan.llm.decontam import decontaminate, digest_rows
from sigscan.llm.embeddings import near_vectors
from sigscan.llm.simhash import simhash_components
from sigscan.llm.spelling import group_spellings
from sigscan.llm.tokens import token_output
from sigscan.llm.warc import warc_round_trip
from sigscan.session import table


def vocabulary(name: str) -> str:
    """Path of a public vocabulary file, where the box provides them."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_rows(decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op2_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "first_slot")


def _held_out(n: int, rest: int):
    return F.coalesce(crc_mod(F.col("doc_id"), n) == rest, F.lit(False)).alias("held_out")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model).select("doc_id", _held_out(4, 2), "score", "predicted")


def op4_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, pieces = table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model")
    return tokencount.count_tokens(docs, pieces, tokencount.fit(docs, pieces))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.train(docs)).select("doc_id", _held_out(3, 1), "lang_pred", "score", "ambiguous")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, offending=True).select("doc_id", _held_out(5, 0), "score", "predicted", "offending")


def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_damaged(table(spark, sf_dir, "conversations"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_spellings(table(spark, sf_dir, "documents"))


def op13_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chatformat.chat_round_trip(table(spark, sf_dir, "conversations"))


QUERIES = {
    "op1_decontaminate": op1_decontaminate,
    "op2_mix": op2_mix,
    "op3_quality": op3_quality,
    "op4_near_vectors": op4_near_vectors,
    "op5_warc": op5_warc,
    "op6_simhash": op6_simhash,
    "op7_token_output": op7_token_output,
    "op8_token_counts": op8_token_counts,
    "op9_language": op9_language,
    "op10_toxicity": op10_toxicity,
    "op11_repair": op11_repair,
    "op12_spelling": op12_spelling,
    "op13_chat_format": op13_chat_format,
}

_CONTROL = r"'\[\\*(?:/?INST|/?SYS|/?ROLE|TEXT)\]|<\\*/?s>'"
_AROUND = " ".join(f"WHEN '{role}' THEN {len(a) + len(b) + 1}" for role, (a, b) in chatformat.MARKS.items())

#: crc32 of the text s: each byte is taken into the register, which is shifted by eight bits.
_BYTE = "list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, i: xor(v >> 1, (v & 1) * 3988292384))"
_CRC = f"xor(list_reduce([CAST(4294967295 AS BIGINT)] || list_transform(range(0, octet_length(encode(s))), lambda i: CAST('0x' || substr(hex(s), 2 * i + 1, 2) AS BIGINT)), lambda c, b: {_BYTE}), 4294967295)"


def _edited(state: str, cost: str, initial: str, line: str = "''") -> str:
    """A state of the repair (cost, audit, repaired rows) after an edit."""
    return f"CASE WHEN {state} IS NOT NULL THEN {{'c': {state}.c + {cost}, 'a': {state}.a || '{initial}', 'r': {state}.r || {line}}} END"


def _repair_step() -> str:
    """The states of each conversation after one more row, at the start, after a system row, a user, an assistant."""
    keep = lambda k, initial: f"CASE WHEN fault NOT IN (1, 2) AND left(role, 1) = '{initial}' THEN {_edited(f's{k}', 'late', 'K', 'line')} END"
    name = lambda k, role: f"CASE WHEN fault NOT IN (1, 2) THEN {_edited(f's{k}', '3 + late', 'R', f'chr(10) || {chr(39)}{role}:{chr(39)} || text')} END"
    gone = [_edited(f"s{k}", "4", "D") for k in range(4)]
    into = {1: [keep(0, "s")], 2: [f(k, x) for k in (0, 1, 3) for f, x in ((keep, "u"), (name, "user"))], 3: [keep(2, "a"), name(2, "assistant")]}
    row = ", ".join([f"{gone[0]} AS n0", *(f"list_min([{', '.join([gone[k], *into[k]])}]) AS n{k}" for k in (1, 2, 3))])
    user, reply = (f"chr(10) || '{r}:'" for r in ("user", "assistant"))
    more = ", ".join(_edited(f"n{k}", "3", "I", user) for k in (0, 1, 3))
    return f"""
            SELECT conv_id, k + 1, n0, n1, n2, list_min([n3, {_edited('n2', '3', 'I', reply)}])
            FROM (SELECT conv_id, k, n0, n1, n3, list_min([n2, {more}]) AS n2
                  FROM (SELECT conv_id, k, {row}
                        FROM (SELECT t.*, role, text, fault, CASE WHEN fault = 3 THEN 3 ELSE 0 END AS late, chr(10) || role || ':' || text AS line
                              FROM steps t JOIN placed p ON t.conv_id IS NOT DISTINCT FROM p.conv_id AND t.k = p.k)))"""


_FOLD = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_RUNS = _FOLD.replace("{}", r"unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]{7,}'))")
_WORDS = r"regexp_extract_all(" + _FOLD + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLES: dict[str, str] = {
    "op1_decontaminate": f"""
        WITH d AS (SELECT doc_id, row_number() OVER () AS r, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
        b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS.format("coalesce(text, '')")} AS w FROM benchmark),
        windows AS (
            SELECT DISTINCT item, array_to_string(list_slice(w, k, k + 12), ' ') AS s, least(13, len(w)) AS n
            FROM (SELECT item, w, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS k FROM b WHERE len(w) > 0)),
        lengths AS (SELECT DISTINCT n FROM windows),
        places AS (
            SELECT r, n, k, array_to_string(list_slice(w, k, k + n - 1), ' ') AS s
            FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, lengths WHERE len(w) >= n)),
        found AS (SELECT r, k, p.n AS n, item FROM places p JOIN windows v ON p.s = v.s AND p.n = v.n),
        words AS (SELECT r, count(DISTINCT j) AS n_hit FROM (SELECT r, unnest(range(k, k + n)) AS j FROM (SELECT DISTINCT r, k, n FROM found)) GROUP BY r),
        items AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT r, item FROM found WHERE item IS NOT NULL) GROUP BY r)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
               sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
        FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r)""",
    "op2_mix": r"""
        WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
                          md5(concat_ws('|', CAST(doc_id AS VARCHAR), text)) AS h FROM documents),
        s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
        w AS (SELECT *, CAST(list_extract([5, 2, 1], ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3) + 1) AS DOUBLE) AS weight, 2.0 * source_size::DOUBLE AS cap FROM s),
        o AS (SELECT *, 1.5::DOUBLE * sum(source_size) OVER () AS total,
                     coalesce(sum(cap) OVER q, 0) AS used, sum(weight) OVER () - coalesce(sum(weight) OVER q, 0) AS open
              FROM w WINDOW q AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        l AS (SELECT *, (total - used) / open AS level FROM o),
        m AS (SELECT first(level ORDER BY cap / weight, source NULLS LAST) AS level FROM l WHERE weight * level <= cap),
        t AS (SELECT source, source_size, CASE WHEN (SELECT level FROM m) IS NULL THEN cap ELSE least(cap, weight * (SELECT level FROM m)) END AS target FROM l),
        p AS (SELECT *, CAST(sum(size) OVER (PARTITION BY source ORDER BY h, doc_id ROWS UNBOUNDED PRECEDING) AS BIGINT) - size AS a FROM d),
        b AS (SELECT source, source_size, CAST(round(target) AS BIGINT) AS goal, CAST(ceil(source_size / 8192) AS BIGINT) AS blocks FROM t),
        n AS (SELECT *, CAST(CASE WHEN goal <= source_size THEN ceil(goal / 8192) ELSE blocks + ceil((goal - source_size) / 8192) END AS BIGINT) AS slots FROM b),
        c AS (SELECT *, sum(slots) OVER (ORDER BY source NULLS LAST) AS upto, sum(slots) OVER () AS total FROM n WHERE slots > 0),
        shares AS (SELECT *, floor((upto - slots)::DOUBLE / total::DOUBLE * TURN::DOUBLE) AS low, floor(upto::DOUBLE / total::DOUBLE * TURN::DOUBLE) AS high FROM c),
        points AS (SELECT i AS slot, CAST((i::HUGEINT * STEP) % TURN AS BIGINT) AS point FROM range(CAST((SELECT 3 * coalesce(max(total), 0) FROM c) AS BIGINT)) r(i)),
        ranked AS (SELECT s.*, slot, row_number() OVER (PARTITION BY source ORDER BY slot) - 1 AS k FROM points JOIN shares s ON point >= low AND point < high),
        firsts AS (SELECT source, k AS block, slot FROM ranked WHERE k < least(slots, blocks))
        SELECT doc_id, size, p.source_size, target, taken, CASE WHEN size > 0 AND taken > 0 THEN slot END AS first_slot FROM (
            SELECT doc_id, size, t.source, t.source_size, target, a,
                   greatest(0, least(size, CAST(round(target) AS BIGINT) - a)) + greatest(0, least(size, CAST(round(target) AS BIGINT) - source_size - a)) AS taken
            FROM p JOIN t ON p.source IS NOT DISTINCT FROM t.source) p
        LEFT JOIN firsts f ON p.source IS NOT DISTINCT FROM f.source AND f.block = a // 8192""".replace("STEP", str(mixing.STEP)).replace("TURN", str(mixing.TURN)),
    "op4_near_vectors": """
        WITH RECURSIVE v AS (
            SELECT row_number() OVER () AS r, vec_id, label, len(embedding) AS n, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
            WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
              AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
        links AS (SELECT a.r AS r, a.vec_id AS vec_id, b.r AS s, b.vec_id AS other FROM v a JOIN v b ON a.label = b.label AND a.n = b.n AND a.r <> b.r WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
        reach AS (SELECT r, s, other FROM links UNION SELECT reach.r, links.s, links.other FROM reach JOIN links ON reach.s = links.r),
        counts AS (SELECT r, vec_id, count(*) AS n FROM links GROUP BY r, vec_id),
        least_ids AS (SELECT r, min(other) AS m FROM reach GROUP BY r),
        known AS (SELECT vec_id, n, m FROM counts JOIN least_ids USING (r))
        SELECT e.vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, CASE WHEN m < e.vec_id THEN m ELSE e.vec_id END AS component_id, coalesce(m IS NULL OR m >= e.vec_id, false) AS kept
        FROM embeddings e LEFT JOIN known ON e.vec_id = known.vec_id""",
    "op5_warc": """
        WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS h FROM pages),
        s AS (SELECT page_id, CAST(octet_length(h) AS BIGINT) AS n, sha256(h) AS d FROM p),
        f AS (SELECT *, min(page_id) OVER (PARTITION BY d) AS first FROM s)
        SELECT page_id, n AS payload_bytes, d AS payload_digest,
               CASE WHEN n >= 100 AND page_id IS DISTINCT FROM first AND first IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN n >= 100 AND page_id IS DISTINCT FROM first THEN first END AS refers_to
        FROM f""",
    "op11_repair": f"""
        WITH RECURSIVE src AS (
            SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS s FROM conversations),
        kinds AS (SELECT *, {_CRC} % 20 AS kind FROM src),
        damaged AS (
            SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy,
                   CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text FROM kinds WHERE kind <> 0),
        ordered AS (
            SELECT *, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS tail,
                   row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(concat_ws(':', coalesce(CAST(conv_id AS VARCHAR), ''), CAST(length(role) AS VARCHAR), role, text))) - 1 AS k FROM damaged),
        placed AS (
            SELECT *, CASE WHEN tail = '' THEN 1 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY k) > 1 THEN 2 WHEN right(tail, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault,
                   lag(role) OVER (PARTITION BY conv_id ORDER BY k) AS before FROM ordered),
        counts AS (
            SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 1) AS blank, count(*) FILTER (WHERE fault = 2) AS duplicate,
                   count(*) FILTER (WHERE fault = 3) AS truncated, count(*) FILTER (WHERE before IS NOT NULL AND left(before, 1) || left(role, 1) NOT IN ('su', 'ua', 'au')) AS illegal FROM placed GROUP BY conv_id),
        steps AS (
            SELECT conv_id, CAST(0 AS BIGINT) AS k, {{'c': CAST(0 AS BIGINT), 'a': '', 'r': ''}} AS s0, CAST(NULL AS STRUCT(c BIGINT, a VARCHAR, r VARCHAR)) AS s1,
                   {{'c': CAST(3 AS BIGINT), 'a': 'I', 'r': chr(10) || 'user:'}} AS s2, {{'c': CAST(6 AS BIGINT), 'a': 'II', 'r': chr(10) || 'user:' || chr(10) || 'assistant:'}} AS s3 FROM counts
            UNION ALL {_repair_step()}),
        done AS (SELECT t.conv_id, list_min([s0, s3]) AS best FROM steps t JOIN counts c ON t.conv_id IS NOT DISTINCT FROM c.conv_id AND t.k = c.n)
        SELECT i.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated,
               CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(best.c, 0) AS BIGINT) AS cost, coalesce(best.a, '') AS audit, sha256(coalesce(substr(best.r, 2), '')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) i LEFT JOIN counts c ON i.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN done d ON i.conv_id IS NOT DISTINCT FROM d.conv_id""",
    "op12_spelling": f"""
        WITH RECURSIVE runs AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, {_RUNS} AS run FROM documents),
        each AS (SELECT id, run, count(*) AS c, id || ':' || run AS s FROM runs GROUP BY id, run),
        hashed AS (SELECT run, c, {_CRC} AS h FROM each),
        cut AS (SELECT CASE WHEN h % 31 = 0 THEN left(run, CAST(h % length(run) AS INTEGER)) || substr(run, CAST(h % length(run) AS INTEGER) + 2) ELSE run END AS word, c FROM hashed),
        words AS (SELECT word, CAST(sum(c) AS BIGINT) AS n FROM cut WHERE length(word) >= 7 GROUP BY word HAVING sum(c) >= 2),
        places AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words),
        holes AS (SELECT word, n, i, left(word, CAST(i AS INTEGER) - 1) AS a, substr(word, CAST(i AS INTEGER) + 1) AS b FROM places),
        shorter AS (SELECT DISTINCT word, n, a || b AS rest FROM holes),
        near AS (
            SELECT x.word, y.word AS other, y.n AS m FROM holes x JOIN holes y ON x.a = y.a AND x.b = y.b AND x.word <> y.word
            UNION ALL SELECT x.word, w.word, w.n FROM shorter x JOIN words w ON x.rest = w.word
            UNION ALL SELECT w.word, x.word, x.n FROM shorter x JOIN words w ON x.rest = w.word),
        best AS (SELECT word, count(*) AS n_near, first(other ORDER BY m DESC, other) AS other, max(m) AS m FROM near GROUP BY word),
        forms AS (SELECT w.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 10 * n THEN other END AS form, CASE WHEN m >= 10 * n THEN m END AS form_n FROM words w LEFT JOIN best USING (word)),
        ways AS (SELECT word, word AS root, form AS next FROM forms UNION ALL SELECT v.word, f.word, f.form FROM ways v JOIN forms f ON v.next = f.word)
        SELECT f.word, form, root, n, CAST(n_near AS BIGINT) AS n_near, form_n FROM forms f JOIN ways v ON f.word = v.word AND v.next IS NULL""",
    "op13_chat_format": f"""
        WITH t AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')))
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
               CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
               sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '')) AS loss_sha256,
               CAST(sum(length(text) + len(regexp_extract_all(text, {_CONTROL})) + CASE role {_AROUND} ELSE {sum(map(len, chatformat.OTHER)) + 1} + length(role) + len(regexp_extract_all(role, {_CONTROL})) END) AS BIGINT) AS formatted_chars
        FROM t GROUP BY conv_id""",
}

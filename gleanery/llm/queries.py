"""Registered queries of the operators, and the same in SQL where it can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from gleanery.llm import (
    chat, decontamination, embeddings, language, line_dedup, merkle, mixing, near_dup, prefix_trie,
    secrets, sharding, suffix_tree, token_counts)
from gleanery.llm.common import table


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op2_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree.score_documents(table(spark, sf_dir, "documents"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(table(spark, sf_dir, "documents"),
                                        table(spark, sf_dir, "benchmark"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.section_tokens(table(spark, sf_dir, "documents"))


def op5_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"), k=2)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(table(spark, sf_dir, "documents"))


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = chat.with_probe(table(spark, sf_dir, "conversations"))
    return chat.digest_formatted(chat.format_conversations(turns)).drop("n_tokens", "loss_tokens")


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_report(table(spark, sf_dir, "documents"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


def op10_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_embeddings(table(spark, sf_dir, "embeddings"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest_proofs(table(spark, sf_dir, "documents"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_nodes(table(spark, sf_dir, "conversations"))


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_digests(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (
        op1_sharding, op2_suffix_tree, op3_decontamination, op4_token_counts, op5_near_dup,
        op6_mixing, op7_chat_format, op8_secret_scan, op9_language_id, op10_embeddings,
        op11_merkle_manifest, op12_prefix_trie, op13_line_dedup, pipeline)}


# ------------------------------------------------------------------ SQL side

def _quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _chat_sql() -> str:
    controls = "|".join(c.replace("[", r"\[").replace("]", r"\]") for c in chat.CONTROL)
    escaped = rf"regexp_replace({{}}, '(\\*(?:{controls}))', '\\\1', 'g')"
    probe = " UNION ALL ".join(
        f"SELECT {chat.PROBE_ID}, {i}, {_quoted(role)}, {_quoted(text)}"
        for i, (role, text) in enumerate(chat.PROBE))
    block = (f"'<s>[ROLE] ' || {escaped.format('role')} || ' [/ROLE] ' || {escaped.format('text')}"
             " || ' </s>'")
    order = "'' ORDER BY turn NULLS FIRST, role, text"
    return (
        "WITH turns AS (SELECT conv_id, turn, coalesce(role, '') AS role,"
        f" coalesce(text, '') AS text FROM conversations UNION ALL {probe}),"
        " joined AS (SELECT conv_id, count(*) AS n_turns,"
        f" string_agg(role || chr(10) || text || chr(10), {order}) AS whole,"
        " coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text)"
        " FILTER (WHERE role = 'assistant'), '') AS learned,"
        f" string_agg({block}, {order}) AS formatted FROM turns GROUP BY conv_id)"
        " SELECT conv_id, n_turns, sha256(whole) AS turns_sha256,"
        " CAST(length(learned) AS BIGINT) AS loss_chars, sha256(learned) AS loss_sha256,"
        " CAST(length(formatted) AS BIGINT) AS formatted_chars FROM joined")


def _secrets_sql() -> str:
    """Matches and what lies between them give the places, as on the Spark side;
    entropy is counted anew for every window."""
    run = "[A-Za-z0-9+/_=-]{20,}"
    window = secrets.WINDOW

    def found(name, pattern, kind, keep):
        pattern = _quoted(pattern)
        return (
            f"{name} AS (SELECT doc_id, {kind} AS kind, m[i] AS match,"
            " CAST(list_sum(list_transform(g[1:i], lambda x: length(x)))"
            " + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0) AS BIGINT)"
            f" AS s FROM (SELECT doc_id, regexp_extract_all(text, {pattern}) AS m,"
            f" string_split_regex(text, {pattern}) AS g, unnest(range(1, 1 + len("
            f"regexp_extract_all(text, {pattern})))) AS i FROM documents"
            f" WHERE regexp_matches(text, {pattern})) WHERE {keep})")

    least = (f"list_min(list_transform(range(1, length(match) - {window - 2}), lambda i:"
             f" list_sum(list_transform(list_distinct(string_split(substr(match, i, {window}), '')),"
             f" lambda c: ({window} - length(replace(substr(match, i, {window}), c, '')))"
             f" * log2({window} - length(replace(substr(match, i, {window}), c, ''))))))) ")
    level = "CASE " + " ".join(f"WHEN regexp_matches(match, {_quoted(p)}) THEN {bits}"
                               for p, bits in secrets.CLASSES[:-1]) \
        + f" ELSE {secrets.CLASSES[-1][1]} END"
    long_enough = (f"length(regexp_extract(m[i], {_quoted(secrets.ASSIGN)}, 1))"
                   f" >= {secrets.ASSIGN_LENGTH}")
    letter_and_digit = "regexp_matches(m[i], '[0-9]') AND regexp_matches(m[i], '[A-Za-z]')"
    names = "['" + "','".join(secrets.KINDS) + "']"
    joined = (f"coalesce(string_agg({names}[kind] || ':' || s || ':' || e, ',' ORDER BY s, kind, e)"
              "{}, '')")
    return (
        f"WITH {found('a', secrets.ASSIGN, 1, long_enough)},"
        f" {found('b', secrets.ACCESS, 2, 'true')}, {found('c', secrets.HEX, 3, 'true')},"
        f" {found('r', run, 4, letter_and_digit)},"
        " base AS (SELECT doc_id, kind, s, s + length(match) AS e FROM (SELECT * FROM a"
        " UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c)),"
        " extra AS (SELECT doc_id, kind, s, s + length(match) AS e FROM r WHERE"
        f" NOT regexp_matches(lower(match), {_quoted('|'.join(secrets.ALLOWED))})"
        f" AND log2({window}) - {least} / {window} >= {level}"
        " AND NOT EXISTS (SELECT 1 FROM base WHERE base.doc_id = r.doc_id AND base.s < r.s"
        " + length(r.match) AND r.s < base.e)),"
        f" marks AS (SELECT doc_id, {joined.format(' FILTER (WHERE kind < 4)')} AS base_spans,"
        f" {joined.format('')} AS spans, count(*) FILTER (WHERE kind = 1) AS n1,"
        " count(*) FILTER (WHERE kind = 2) AS n2, count(*) FILTER (WHERE kind = 3) AS n3"
        " FROM (SELECT * FROM base UNION ALL SELECT * FROM extra) GROUP BY doc_id)"
        " SELECT doc_id, coalesce(n1, 0) AS n_assign, coalesce(n2, 0) AS n_access,"
        " coalesce(n3, 0) AS n_hex, sha256(coalesce(base_spans, '')) AS base_sha256,"
        " coalesce(spans, '') AS spans FROM documents LEFT JOIN marks USING (doc_id)")


def _components_sql(key: str) -> str:
    """``least``: the smallest key that each one of ``links`` (a, b, both ways) reaches."""
    return (f" reach AS (SELECT a AS {key}, a AS root FROM links UNION SELECT l.b, r.root FROM"
            f" reach r JOIN links l ON l.a = r.{key}),"
            f" least AS (SELECT {key}, min(root) AS root FROM reach GROUP BY {key})")


def _near_dup_sql() -> str:
    """All pairs that share a shingle."""
    lower = f"translate(coalesce(text, ''), '{merkle.UPPER}', '{merkle.LOWER}')"
    return (
        rf"WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({lower}, '[^\x20\x09-\x0D]+') AS w"
        " FROM documents), sets AS (SELECT doc_id, CASE WHEN len(w) > 1 THEN list_distinct("
        "list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) ELSE w END AS s FROM w),"
        " grams AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),"
        " shared AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) + any_value(b.n) AS n,"
        " count(*) AS m FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id"
        " AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) GROUP BY a.doc_id, b.doc_id),"
        f" links AS (SELECT a, b FROM shared WHERE 100 * m >= 80 * (n - m)), {_components_sql('doc_id')}"
        " SELECT doc_id, len(s) AS n_shingles, coalesce(root, doc_id) AS component_id,"
        " coalesce(root, doc_id) = doc_id AS kept FROM sets LEFT JOIN least USING (doc_id)")


def _embeddings_sql() -> str:
    """All pairs of a label."""
    return (
        "WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x:"
        " CAST(x AS DOUBLE)) AS e FROM embeddings), ok AS (SELECT vec_id, label, e,"
        " sqrt(list_dot_product(e, e)) AS norm FROM v WHERE label IS NOT NULL AND e IS NOT NULL"
        " AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0"
        " AND len(list_filter(e, lambda x: x <> 0)) > 0),"
        " links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label"
        " AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)"
        f" WHERE list_dot_product(a.e, b.e) / (a.norm * b.norm) >= {embeddings.COSINE}),"
        f" {_components_sql('vec_id')}, counts AS (SELECT a AS vec_id, count(*) AS n FROM links"
        " GROUP BY a)"
        " SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(root, vec_id) AS component_id,"
        " coalesce(root, vec_id) = vec_id AS kept FROM embeddings LEFT JOIN least USING (vec_id)"
        " LEFT JOIN counts USING (vec_id)")


def _crc_sql(digits: str) -> str:
    """CRC-32 of a short ASCII text, bit by bit."""
    byte = "list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y:" \
        " xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END))"
    codes = f"list_transform(range(1, length({digits}) + 1), lambda i: ascii(substr({digits}, i, 1)))"
    return (f"xor(list_reduce(list_prepend(4294967295::BIGINT, {codes}::BIGINT[]),"
            f" lambda c, b: {byte}), 4294967295)")


def _merkle_sql(levels: int = 5, top_levels: int = 3) -> str:
    """The trees level by level; every leaf climbs with the runs it is in."""
    def field(column):
        value = f"CAST({column} AS VARCHAR)"
        return f"CASE WHEN {column} IS NULL THEN '-' ELSE strlen({value}) || ':' || {value} END"

    fields = " || ".join(field(c) for c in ("doc_id", "source", "lang", "n_chars"))
    lower = f"translate(text, '{merkle.UPPER}', '{merkle.LOWER}')"
    lowered = f"CASE WHEN text IS NULL THEN '-' ELSE strlen({lower}) || ':' || {lower} END"
    parts = [
        f"marked AS (SELECT doc_id, source, sha256({fields} || {field('text')}) AS leaf,"
        f" CASE WHEN {_crc_sql('CAST(doc_id AS VARCHAR)')} % 5 = 0"
        f" THEN sha256({fields} || {lowered}) END AS changed FROM documents)",
        "placed AS (SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS s,"
        " row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i,"
        " count(*) OVER (PARTITION BY source) AS n FROM marked)",
        "t0 AS (SELECT s, i, n, leaf AS h FROM placed)",
        "c0 AS (SELECT doc_id, s, i, leaf, coalesce(changed, leaf) AS own, '' AS proof FROM placed)"]

    def climb(at, tree, climber):
        parts.append(
            f"r{at} AS (SELECT s, i // 16 AS j, any_value(n) AS n, list(h ORDER BY i) AS hs"
            f" FROM {tree} GROUP BY s, i // 16)")
        parts.append(
            f"t{at + 1} AS (SELECT s, j AS i, (n + 15) // 16 AS n, CASE WHEN n > 1"
            f" THEN sha256(array_to_string(hs, '')) ELSE hs[1] END AS h FROM r{at})")
        parts.append(
            f"c{at + 1} AS (SELECT doc_id, s, i // 16 AS i, leaf, CASE WHEN n > 1 THEN"
            " sha256(array_to_string(hs[1:i % 16], '') || own || array_to_string(hs[i % 16 + 2:], ''))"
            " ELSE own END AS own, proof || CASE WHEN n > 1 THEN array_to_string(hs[1:i % 16], '')"
            f" || array_to_string(hs[i % 16 + 2:], '') ELSE '' END AS proof {{}} FROM {climber}"
            f" JOIN r{at} USING (s) WHERE i // 16 = j)")

    for at in range(levels):
        climb(at, f"t{at}", f"c{at}")
        parts[-1] = parts[-1].format("")
    parts += [
        f"subroots AS (SELECT s AS place, h AS subroot FROM t{levels})",
        "u AS (SELECT 0 AS s, place AS i, count(*) OVER () AS n, subroot AS h FROM subroots)",
        f"v AS (SELECT doc_id, 0 AS s, s AS i, leaf, own, proof, subroot FROM c{levels}"
        " JOIN subroots ON s = place)"]
    tree, climber = "u", "v"
    for at in range(levels + 1, levels + 1 + top_levels):
        climb(at, tree, climber)
        parts[-1] = parts[-1].format(", subroot")
        tree, climber = f"t{at + 1}", f"c{at + 1}"
    return (f"WITH {', '.join(parts)} SELECT doc_id, leaf, subroot, h AS root,"
            f" sha256(proof) AS proof_sha256, own AS folded_root, own = h AS verified"
            f" FROM {climber} JOIN {tree} USING (s)")


def _trie_sql() -> str:
    """Every prefix of every rebuilt conversation as a list of turns."""
    h = _crc_sql("CAST(conv_id AS VARCHAR)")
    return (
        "WITH own AS (SELECT conv_id, list({'role': coalesce(role, ''), 'text': coalesce(text, '')}"
        " ORDER BY turn NULLS FIRST) AS turns FROM conversations WHERE conv_id IS NOT NULL"
        f" GROUP BY conv_id), opened AS (SELECT *, {h} % 6 AS h FROM own),"
        " rebuilt AS (SELECT o.conv_id, list_concat(coalesce(b.turns[1:o.h], []), o.turns[o.h + 1:])"
        " AS turns FROM opened o LEFT JOIN own b ON b.conv_id = o.conv_id - o.conv_id % 100),"
        " prefixes AS (SELECT conv_id, len(turns) AS length, unnest(range(len(turns) + 1)) AS depth,"
        " turns FROM rebuilt),"
        " named AS (SELECT conv_id, length, depth, turns[depth].text AS last, CASE WHEN depth = 0"
        " THEN '' ELSE md5(CAST(turns[1:depth] AS VARCHAR)) END AS name, CASE WHEN depth < 2 THEN ''"
        " ELSE md5(CAST(turns[1:depth - 1] AS VARCHAR)) END AS parent FROM prefixes),"
        " nodes AS (SELECT depth, name, any_value(parent) AS parent, min(conv_id) AS conv_id,"
        " count(*) AS n_convs, coalesce(length(any_value(last)), 0) AS chars,"
        " sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id)"
        " FILTER (WHERE length = depth), '')) AS ends_sha256 FROM named GROUP BY depth, name),"
        " children AS (SELECT p.depth, p.name, count(c.name) AS n_children FROM nodes p LEFT JOIN"
        " nodes c ON c.parent = p.name AND c.depth = p.depth + 1 GROUP BY p.depth, p.name),"
        " below AS (SELECT DISTINCT up.depth, up.name, lo.depth AS d, lo.name AS node FROM named up"
        " JOIN named lo ON up.conv_id = lo.conv_id AND lo.depth >= up.depth),"
        " sums AS (SELECT b.depth, b.name, sum((n.n_convs - 1) * n.chars) AS saved_tokens,"
        " count(*) FILTER (WHERE c.n_children = 0) AS n_leaves FROM below b JOIN nodes n"
        " ON n.depth = b.d AND n.name = b.node JOIN children c ON c.depth = b.d AND c.name = b.node"
        " GROUP BY b.depth, b.name)"
        " SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, c.n_children, s.n_leaves,"
        " CAST(s.saved_tokens AS BIGINT) AS saved_tokens, n.ends_sha256 FROM nodes n"
        " JOIN children c USING (depth, name) JOIN sums s USING (depth, name)"
        " LEFT JOIN nodes p ON p.name = n.parent AND p.depth = n.depth - 1")


def _lines_sql() -> str:
    spaces = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return (
        "WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),"
        " lines AS (SELECT doc_id, unnest(l) AS line, unnest(range(len(l))) AS place FROM split),"
        f" keyed AS (SELECT *, translate(trim(line, {spaces}), '{upper}', '{lower}') AS key FROM lines),"
        " common AS (SELECT key FROM keyed WHERE key <> '' GROUP BY key"
        " HAVING count(DISTINCT doc_id) >= 10)"
        " SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE c.key IS NOT NULL) AS n_dropped,"
        " sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE c.key IS NULL), ''))"
        " AS kept_sha256 FROM keyed LEFT JOIN common c USING (key) GROUP BY doc_id")


def oracle_sql() -> dict[str, str]:
    own = {"op7_chat_format": _chat_sql(), "op8_secret_scan": _secrets_sql(),
           "op5_near_dup": _near_dup_sql(), "op10_embeddings": _embeddings_sql(),
           "op11_merkle_manifest": _merkle_sql(), "op12_prefix_trie": _trie_sql(),
           "op13_line_dedup": _lines_sql()}
    return {**own, "pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else own

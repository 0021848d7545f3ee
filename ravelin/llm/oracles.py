"""SQL for DuckDB of the operators that SQL can express, by plain definition rather than by the operators' methods."""

from . import chat, secrets

_RUN = r"'[^\x20\x09-\x0D]+'"

SUBSTRINGS = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {_RUN}) AS w FROM documents),
runs AS (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13),
g AS (SELECT doc_id, i, array_to_string(w[i : i + 12], ' ') AS run FROM runs),
first AS (SELECT run, min(doc_id) AS least FROM g GROUP BY run),
hit AS (SELECT g.doc_id, g.i FROM g JOIN first USING (run) WHERE least < g.doc_id),
gone AS (SELECT DISTINCT doc_id, i + o.range AS p FROM hit CROSS JOIN range(13) o),
words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d),
kept AS (SELECT words.doc_id, count(gone.p) AS n_removed, string_agg(word, ' ' ORDER BY words.p) FILTER (WHERE gone.p IS NULL) AS text FROM words LEFT JOIN gone ON gone.doc_id = words.doc_id AND gone.p = words.p GROUP BY words.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256 FROM d LEFT JOIN kept ON kept.doc_id = d.doc_id
"""

EMBEDDINGS = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
sound AS (SELECT vec_id, e FROM v WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM sound a JOIN sound b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
reach(n, r) AS (SELECT vec_id, vec_id FROM v UNION SELECT reach.n, link.b FROM reach JOIN link ON link.a = reach.r),
least AS (SELECT n, min(r) AS component_id FROM reach GROUP BY n)
SELECT vec_id, (SELECT count(*) FROM link WHERE a = vec_id) AS n_links, component_id, vec_id = component_id AS kept FROM v JOIN least ON n = vec_id
"""


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _secrets() -> str:
    assign, allowed = _quoted(secrets.ASSIGN), _quoted(secrets.ALLOWED)
    run = _quoted("[A-Za-z0-9+/_=-]{20,}")
    bits = "CASE " + " ".join(f"WHEN regexp_matches(m, {_quoted(p)}) THEN {b}" for p, b in secrets.THRESHOLDS.items() if p) + f" ELSE {secrets.THRESHOLDS['']} END"

    def found(name: str, pattern: str) -> str:
        return (
            f"{name}_all AS (SELECT doc_id, regexp_extract_all(t, {pattern}) AS ms, string_split_regex(t, {pattern}) AS gaps FROM d), "
            f"{name}_each AS (SELECT doc_id, ms, gaps, unnest(range(1, len(ms) + 1)) AS k FROM {name}_all), "
            f"{name} AS (SELECT doc_id, k, ms[k] AS m, CAST(list_sum(list_transform(gaps[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:k-1], lambda x: length(x))), 0) AS BIGINT) AS s FROM {name}_each)"
        )

    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
{found("assign", assign)},
{found("access", _quoted(secrets.ACCESS))},
{found("hex", _quoted(secrets.HEX))},
{found("run", run)},
base AS (
  SELECT doc_id, 0 AS kind, s, s + length(m) AS e FROM assign WHERE length(regexp_extract(m, {assign}, 2)) >= 12
  UNION ALL SELECT doc_id, 1, s, s + length(m) FROM access
  UNION ALL SELECT doc_id, 2, s, s + length(m) FROM hex),
candidate AS (SELECT doc_id, k, m, s, {bits} AS bits FROM run WHERE regexp_matches(m, '[0-9]') AND NOT regexp_matches(m, {allowed})),
place AS (SELECT doc_id, k, m, s, bits, unnest(range(0, length(m) - {secrets.WINDOW - 1})) AS i FROM candidate),
letter AS (SELECT doc_id, k, s, bits, i, unnest(string_split(substr(m, CAST(i + 1 AS INTEGER), {secrets.WINDOW}), '')) AS c FROM place),
counted AS (SELECT doc_id, k, s, bits, i, c, count(*) AS n FROM letter GROUP BY ALL),
hit AS (SELECT doc_id, k, s, i FROM counted GROUP BY doc_id, k, s, bits, i HAVING log2({secrets.WINDOW}) - sum(n * log2(n)) / {secrets.WINDOW} >= bits - 1e-9),
step AS (SELECT *, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id, k ORDER BY i) + {secrets.WINDOW} THEN 0 ELSE 1 END AS fresh FROM hit),
island AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id, k ORDER BY i) AS no FROM step),
entropy AS (SELECT doc_id, 3 AS kind, s + min(i) AS s, s + max(i) + {secrets.WINDOW} AS e FROM island GROUP BY doc_id, k, s, no),
spans AS (SELECT * FROM base UNION ALL SELECT * FROM entropy x WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = x.doc_id AND b.s <= x.s AND x.e <= b.e)),
said AS (SELECT doc_id, kind, s, ['assign', 'access', 'hex', 'entropy'][kind + 1] || ':' || s || ':' || e AS x FROM spans),
lists AS (SELECT doc_id, count(*) FILTER (WHERE kind = 0) AS n_assign, count(*) FILTER (WHERE kind = 1) AS n_access, count(*) FILTER (WHERE kind = 2) AS n_hex, string_agg(x, ',' ORDER BY s, kind) FILTER (WHERE kind < 3) AS base, string_agg(x, ',' ORDER BY s, kind) AS spans FROM said GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN lists ON lists.doc_id = d.doc_id
"""


SECRETS = _secrets()


def _crc32(text: str) -> str:
    """Unsigned CRC-32 of ASCII text, with crc_table at hand."""
    return f"xor(list_reduce(list_transform(range(1, length({text}) + 1), lambda i: CAST(ascii(substr({text}, i, 1)) AS BIGINT)), lambda c, b: xor(c >> 8, crc_table.t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295)"


_CRC_TABLE = "crc_table AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) AS v FROM range(256) r(i)))"


def _chat() -> str:
    said = "'</s>[INST] ok [/INST]'"
    forms = "|".join(f"{c[0]}Q{c[1:]}".translate({ord(x): "\\" + x for x in "[]|/"}).replace("Q", "\\\\*") for c in chat.CONTROLS)
    marks = lambda x: f"len(regexp_extract_all({x}, {_quoted(forms)}))"
    return f"""
WITH r AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', {said}), (-7, 1, 'assistant', {said})) v(conv_id, turn, role, text)),
said AS (SELECT *, replace(replace(role, chr(92), chr(92) || chr(92)), chr(10), chr(92) || 'n') AS line, CASE WHEN role = 'assistant' THEN text ELSE '' END AS learned FROM r)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(sum(length(learned)) AS BIGINT) AS loss_chars,
  sha256(string_agg(learned, '' ORDER BY turn NULLS FIRST, role, text)) AS loss_sha256,
  CAST(sum(length('<|turn|>') + length(line) + {marks("line")} + 1 + length(text) + {marks("text")} + length('<|end|>') + 1) AS BIGINT) AS formatted_chars,
  CAST(0 AS BIGINT) AS rewritten_chars
FROM said GROUP BY conv_id
"""


CHAT = _chat()


def _merkle() -> str:
    def leaf(text: str) -> str:
        return "sha256(" + " || ".join(f"coalesce(strlen({v}) || ':' || {v}, '-')" for v in ("CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)", text)) + ")"

    def tree(name: str, leaves: str) -> str:
        return f"""{name}(level, g, i, n, digest) AS (
  {leaves}
  UNION ALL SELECT level + 1, g, i // 16, (n + 15) // 16, sha256(string_agg(digest, '' ORDER BY i)) FROM {name} WHERE n > 1 GROUP BY level, g, i // 16, (n + 15) // 16),
{name}_run AS (SELECT level, g, i // 16 AS parent, string_agg(digest, '' ORDER BY i) AS run FROM {name} WHERE n > 1 GROUP BY ALL)"""

    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    step = lambda run, i: f"{i} % 16 AS place, left({run}, 64 * ({i} % 16)) AS before, substr({run}, 64 * ({i} % 16) + 65) AS after"
    return f"""
WITH RECURSIVE {_CRC_TABLE},
d AS (SELECT doc_id, coalesce('=' || source, '') AS g, {leaf("text")} AS leaf, CASE WHEN {_crc32("CAST(doc_id AS VARCHAR)")} % 5 = 0 THEN {leaf(low)} END AS found FROM documents, crc_table),
placed AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM d),
{tree("own", "SELECT 0, g, i, n, leaf FROM placed")},
tops AS (SELECT g, digest FROM own WHERE n = 1),
{tree("over", "SELECT 0, '', row_number() OVER (ORDER BY g) - 1, count(*) OVER (), digest FROM tops")},
root AS (SELECT digest AS root FROM over WHERE n = 1),
named AS (SELECT g, digest AS subroot, row_number() OVER (ORDER BY g) - 1 AS k FROM tops),
steps AS (
  SELECT p.g, p.i, 0 AS phase, r.level, {step("run", "(p.i >> (4 * r.level))")} FROM placed p JOIN own_run r ON r.g = p.g AND r.parent = p.i >> (4 * (r.level + 1))
  UNION ALL SELECT p.g, p.i, 1, r.level, {step("run", "(m.k >> (4 * r.level))")} FROM placed p JOIN named m ON m.g = p.g JOIN over_run r ON r.parent = m.k >> (4 * (r.level + 1))),
told AS (SELECT *, row_number() OVER (PARTITION BY g, i ORDER BY phase, level) AS no FROM steps),
proofs AS (SELECT g, i, sha256(string_agg(before || after, '' ORDER BY no)) AS proof_sha256, max(no) AS most FROM told GROUP BY ALL),
fold(g, i, no, digest) AS (
  SELECT g, i, 0, coalesce(found, leaf) FROM placed
  UNION ALL SELECT t.g, t.i, t.no, sha256(before || digest || after) FROM fold f JOIN told t ON t.g = f.g AND t.i = f.i AND t.no = f.no + 1),
ended AS (SELECT f.g, f.i, f.digest AS folded_root, coalesce(proof_sha256, sha256('')) AS proof_sha256 FROM fold f LEFT JOIN proofs q ON q.g = f.g AND q.i = f.i WHERE f.no = coalesce(most, 0))
SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified FROM placed JOIN named USING (g) JOIN ended USING (g, i), root
"""


MERKLE = _merkle()


def _structure() -> str:
    add = lambda edit, cost, v: f"(lpad(CAST(CAST(left({v}, 8) AS BIGINT) + {cost} AS VARCHAR), 8, '0') || '{edit}' || substr({v}, 9))"

    def before(state: int, **to: int) -> str:
        """The least cost and edits from a state before a row, as eight digits and letters."""
        found = [add("D", 4, f"v{state}")]
        for role, s in to.items():
            found.append(f"CASE WHEN fault NOT IN (1, 2) AND initial = '{role}' THEN {add('K', 'more', f'v{s}')} ELSE 'z' END")
            if role != "s":
                found.append(f"CASE WHEN fault NOT IN (1, 2) THEN {add('R', '3 + more', f'v{s}')} ELSE 'z' END")
        return f"least({', '.join(found)}) AS g{state}"

    return f"""
WITH RECURSIVE {_CRC_TABLE},
d AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
b AS (SELECT d.*, {_crc32("key")} % 20 AS hurt FROM d, crc_table),
k AS (SELECT conv_id, turn, CASE WHEN hurt = 4 THEN 'user' ELSE role END AS role, CASE hurt WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN hurt = 3 THEN 2 ELSE 1 END)) AS copy FROM b WHERE hurt <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(strlen(role) || ':' || role || text), copy) AS p FROM k),
e AS (SELECT *, regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS ending, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY p) AS seen FROM o),
f AS (SELECT *, left(role, 1) AS initial, CASE WHEN ending = '' THEN 1 WHEN seen > 1 THEN 2 WHEN ending NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY p) || left(role, 1) AS pair FROM e),
c AS (SELECT conv_id, max(p) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 1) AS blank, count(*) FILTER (WHERE fault = 2) AS duplicate, count(*) FILTER (WHERE fault = 3) AS truncated, count(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY ALL),
s(conv_id, p, v0, v1, v2, v3) AS (
  SELECT conv_id, n + 1, '00000000', '00000006II', '00000003I', '00000000' FROM c
  UNION ALL SELECT conv_id, p, least(g0, {add("I", 3, "w2")}), least(g1, {add("I", 3, "w2")}), w2, w3 FROM (
    SELECT *, least(g2, {add("I", 3, "g3")}) AS w2, least(g3, {add("I", 3, "g2")}) AS w3 FROM (
      SELECT conv_id, p, {before(0, s=1, u=2)}, {before(1, u=2)}, {before(2, a=3)}, {before(3, u=2)} FROM (
        SELECT s.conv_id, f.p, v0, v1, v2, v3, initial, fault, CASE WHEN fault = 3 THEN 3 ELSE 0 END AS more FROM s JOIN f ON f.conv_id IS NOT DISTINCT FROM s.conv_id AND f.p = s.p - 1)))),
best AS (SELECT conv_id, CAST(left(v0, 8) AS BIGINT) AS cost, substr(v0, 9) AS audit FROM s WHERE p = 1),
edits AS (SELECT conv_id, unnest(string_split(audit, '')) AS edit, unnest(range(1, length(audit) + 1)) AS no FROM best WHERE audit <> ''),
taken AS (SELECT *, count(*) FILTER (WHERE edit <> 'I') OVER (PARTITION BY conv_id ORDER BY no) AS p FROM edits),
met AS (SELECT t.conv_id, t.no, t.edit, CASE WHEN edit = 'I' THEN '' ELSE f.text END AS text, f.role, edit = 'K' AND left(f.role, 1) = 's' AS opens FROM taken t LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM t.conv_id AND f.p = t.p AND t.edit <> 'I'),
kept AS (SELECT *, count(*) FILTER (WHERE NOT coalesce(opens, false)) OVER (PARTITION BY conv_id ORDER BY no) AS placed FROM met WHERE edit <> 'D'),
made AS (SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN placed % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY no) AS t FROM kept GROUP BY ALL),
ids AS (SELECT DISTINCT conv_id FROM conversations)
SELECT ids.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(t, '')) AS repaired_sha256
FROM ids LEFT JOIN c ON c.conv_id IS NOT DISTINCT FROM ids.conv_id LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM ids.conv_id LEFT JOIN made ON made.conv_id IS NOT DISTINCT FROM ids.conv_id
"""


STRUCTURE = _structure()

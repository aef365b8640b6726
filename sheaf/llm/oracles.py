"""Oracle SQL of the llm queries that SQL can express; the others are tested against brute force."""

#: Markup as the operator sees it; entities and invisible characters don't occur in the test data.
_TAG = r"""</?[A-Za-z][\w:.-]*(?:\s+[\w:.-]+\s*=\s*(?:"[^"]*"|[^\s"<>=]+))*\s*/?>"""
_WORDS = f"regexp_extract_all(lower(regexp_replace({{0}}, '{_TAG}', ' ', 'g')), '[\\p{{{{L}}}}\\p{{{{N}}}}]+')"

ORACLES: dict[str, str] = {
    "p9_found": f"""
WITH i AS (SELECT item_id, {_WORDS.format("text")} AS w FROM eval_items),
iw AS (SELECT DISTINCT item_id, array_to_string(list_slice(w, k, k + 12), ' ') AS run FROM (SELECT item_id, w, unnest(range(1, len(w) - 11)) AS k FROM i WHERE len(w) >= 13)),
d AS (SELECT doc_id, {_WORDS.format("text")} AS w FROM documents),
dw AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, k, k + 12), ' ') AS run FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS k FROM d WHERE len(w) >= 13))
SELECT DISTINCT doc_id, item_id FROM dw JOIN iw USING (run)""",
}

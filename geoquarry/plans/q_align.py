"""Queries: alignment, validation, prompts, templates, tool calls."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoquarry.functions import templates as T
from geoquarry.functions import tools
from geoquarry.operators import align as A
from geoquarry.operators import encode, mix
from geoquarry.plans.queries import query
from geoquarry.plans.views import DIALOGUES, HALVES, dialogues, halves, texts
from geoquarry.sources.registry import registry_frame
from geoquarry.tables import table


def aligned(spark: SparkSession, d: str) -> DataFrame:
    prompt, response, system = A.sharegpt(F.col("messages"))
    return dialogues(spark, d).select("ann_id", prompt.alias("_prompt"), response.alias("_response"), system.alias("_system"), A.media(F.col("images")).alias("_images"))


_TEXT = "array_to_string(list_transform({0}, lambda t: t.role || '=' || coalesce(t.content, '')), '|')"


@query(f"""WITH {DIALOGUES}
SELECT ann_id, CASE WHEN valid THEN {_TEXT.format("turns[1:len(turns) - 1]")} ELSE '' END AS prompt, CASE WHEN valid THEN {_TEXT.format("turns[len(turns):]")} ELSE '' END AS response, sys AS system FROM roled""")
def align_sharegpt(spark: SparkSession, d: str) -> DataFrame:
    return aligned(spark, d).select("ann_id", texts(F.col("_prompt")).alias("prompt"), texts(F.col("_response")).alias("response"), F.col("_system").alias("system"))


@query(f"WITH {DIALOGUES} SELECT count(*) FILTER (valid) AS valid, count(*) FILTER (NOT valid) AS broken FROM roled")
def align_valid_counts(spark: SparkSession, d: str) -> DataFrame:
    n = F.size("_response") == 1
    return aligned(spark, d).agg(F.count_if((F.size("_prompt") % 2 == 1) & n).alias("valid"), F.count_if(~((F.size("_prompt") % 2 == 1) & n)).alias("broken"))


@query("""SELECT rec_id, concat_ws(chr(10), nullif(question, ''), nullif(type, '')) AS prompt, coalesce('assistant=' || answer, '') AS response FROM vqa_records""")
def align_alpaca(spark: SparkSession, d: str) -> DataFrame:
    prompt, response = A.alpaca(F.col("question"), F.col("type"), F.col("answer"))
    return table(spark, d, "vqa_records").select("rec_id", prompt[0]["content"].alias("prompt"), texts(response).alias("response"))


@query("""SELECT rec_id, array_to_string(list_filter([
  CASE WHEN length(coalesce(question, '') || coalesce(type, '')) > 0 THEN 'user=' || coalesce(question, '') || coalesce(type, '') || '@0' END,
  CASE WHEN length(answer) > 0 THEN 'assistant=' || answer || '@1' END], lambda x: x IS NOT NULL), '|') AS messages FROM vqa_records""")
def align_v1_alpaca(spark: SparkSession, d: str) -> DataFrame:
    m = A.v1_alpaca(F.col("question"), F.col("type"), F.col("answer"))
    text = F.array_join(F.transform(m, lambda x: F.concat(x["role"], F.lit("="), x["content"][0]["value"], F.lit("@"), x["loss_weight"].cast("int").cast("string"))), "|")
    return table(spark, d, "vqa_records").select("rec_id", text.alias("messages"))


def _feedback(spark: SparkSession, d: str) -> DataFrame:
    prompt, response = A.alpaca(F.col("prompt"), response=F.col("response"), kto=F.col("tag"))
    return halves(spark, d).select("doc_id", "tag", prompt.alias("_prompt"), response.alias("_response"))


@query(f"WITH {HALVES} SELECT doc_id, CASE WHEN tag THEN 'assistant=' || response || '|assistant=' ELSE 'assistant=|assistant=' || response END AS response FROM halves")
def align_kto(spark: SparkSession, d: str) -> DataFrame:
    return _feedback(spark, d).select("doc_id", texts(F.col("_response")).alias("response"))


@query(f"""WITH {HALVES}, n AS (SELECT *, (row_number() OVER (ORDER BY doc_id) - 1) // 1000 AS b, CASE WHEN tag THEN response || '|' ELSE '|' || response END AS r FROM halves)
SELECT doc_id, coalesce(lag(r) OVER w, last_value(r) OVER (PARTITION BY b ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS kl FROM n WINDOW w AS (PARTITION BY b ORDER BY doc_id)""")
def kto_mismatch_shift(spark: SparkSession, d: str) -> DataFrame:
    shifted = A.mismatched(encode.batches(_feedback(spark, d), "doc_id"), "batch_id", "doc_id")
    return shifted.select("doc_id", F.array_join(F.transform("kl_response", lambda m: m["content"]), "|").alias("kl"))


@query(f"WITH {HALVES} SELECT source, count(*) FILTER (tag) AS desirable, count(*) FILTER (NOT tag) AS undesirable, count(*) FILTER (tag) = 0 OR count(*) FILTER (NOT tag) = 0 AS one_sided FROM halves GROUP BY source")
def kto_balance(spark: SparkSession, d: str) -> DataFrame:
    from geoquarry.operators.metrics import feedback_balance

    return feedback_balance(halves(spark, d), "tag", "source")


@query(f"""WITH {HALVES}, n AS (SELECT *, row_number() OVER (PARTITION BY source, tag ORDER BY doc_id) AS k FROM halves)
SELECT a.source, a.k AS pair, a.prompt, a.response AS chosen, b.response AS rejected FROM (SELECT * FROM n WHERE tag) a JOIN (SELECT * FROM n WHERE NOT tag) b USING (source, k)""")
def align_pairwise(spark: SparkSession, d: str) -> DataFrame:
    """The n-th desirable half of a source against its n-th undesirable one; numbered by range, so that no source is sorted in one task."""
    rows = mix.numbered(halves(spark, d).withColumn("_g", F.concat_ws("\x1f", "source", F.col("tag").cast("string"))).withColumn("_order", F.struct("_g", "doc_id")), "_order", "_n")
    firsts = rows.groupBy("_g").agg(F.min("_n").alias("_first"))
    placed = rows.join(firsts, "_g").withColumn("pair", F.col("_n") - F.col("_first") + 1)
    side = lambda t, *names: placed.where(F.col("tag") == t).select("source", "pair", *[F.col(n).alias(m) for n, m in names])
    both = side(True, ("prompt", "prompt"), ("response", "c")).join(side(False, ("response", "r")), ["source", "pair"])
    prompt, response = A.alpaca(F.col("prompt"), chosen=F.col("c"), rejected=F.col("r"))
    return both.select("source", "pair", prompt[0]["content"].alias("prompt"), response[0]["content"].alias("chosen"), response[1]["content"].alias("rejected"))


@query(r"""SELECT doc_id, CAST((length(text) - length(replace(text, '<image>', ''))) / 7 AS INTEGER) AS n_images,
  CASE WHEN (length(text) - length(replace(text, '<image>', ''))) / 7 <> 0 THEN 'image placeholders' END AS reason FROM documents WHERE text IS NOT NULL""")
def placeholder_counts(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").where("text is not null")
    m = F.array(F.struct(F.lit("user").alias("role"), F.col("text").alias("content")))
    return rows.select("doc_id", A.placeholders(F.col("text"), "<image>").alias("n_images"), A.placeholder_check(m, F.lit(None).cast("array<string>")).alias("reason"))


@query(f"""WITH {DIALOGUES}, r AS (
  SELECT ann_id, messages, CASE WHEN len(messages) > 0 AND messages[1]['from'] = 'system' THEN messages[2:] ELSE messages END AS body FROM dlg)
SELECT ann_id, CASE WHEN len(messages) = 0 THEN 'invalid length' WHEN len(body) % 2 = 0 THEN 'only supports u/a/u/a/u'
  WHEN len(list_filter(body, lambda x, i: x['from'] <> CASE WHEN i % 2 = 1 THEN 'human' ELSE 'gpt' END)) > 0 THEN 'invalid role' END AS reason FROM r""")
def request_validation(spark: SparkSession, d: str) -> DataFrame:
    name = lambda m: F.when(m["from"] == "human", "user").when(m["from"] == "gpt", "assistant").otherwise(m["from"])
    m = F.transform("messages", lambda x: F.struct(name(x).alias("role"), x["value"].alias("content")))
    return dialogues(spark, d).select("ann_id", A.request_check(m).alias("reason"))


@query("""SELECT rec_id, 'Task: Answer the following question about the image.' || chr(10) || 'Question: ' || coalesce(question, '') || chr(10) || 'Return only the final answer.' ||
  CASE WHEN contains(lower(coalesce(type, '')), 'quantity') THEN chr(10) || 'Answer with one integer only.' ELSE '' END ||
  CASE WHEN contains(lower(coalesce(type, '')), 'category') THEN chr(10) || 'Answer with one category label only.' ELSE '' END AS prompt FROM vqa_records""")
def vqa_prompt(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "vqa_records").select("rec_id", A.vqa_prompt(F.col("question"), F.col("type")).alias("prompt"))


@query("""SELECT rec_id, coalesce(CASE WHEN length(trim(type)) > 0 THEN type END, CASE WHEN length(trim(question_type)) > 0 THEN question_type END, 'generic') AS kind,
  CASE WHEN image_id IS NULL OR image_id = '' THEN '[ERROR] not found: ' || coalesce(image_id, '') END AS error FROM vqa_records""")
def vqa_record_parse(spark: SparkSession, d: str) -> DataFrame:
    kind, error = A.vqa_record(F.col("image_id"), F.col("type"), F.col("question_type"), F.col("image_id").isNotNull() & (F.col("image_id") != ""))
    return table(spark, d, "vqa_records").select("rec_id", kind.alias("kind"), error.alias("error"))


_U = "CAST(('0x' || substr(md5('{0}:' || {1}), 1, 13))::BIGINT AS DOUBLE) / 4503599627370496.0"


@query(f"""WITH pool AS (SELECT dataset AS g, question || ' = ' || split AS t, row_number() OVER (PARTITION BY dataset ORDER BY md5('5' || chr(31) || item_id)) - 1 AS k, count(*) OVER (PARTITION BY dataset) AS n FROM eval_items),
size AS (SELECT DISTINCT g, n, least(3, n) AS m FROM pool),
a AS (SELECT e.item_id AS target, e.question AS q, s.*, floor({_U.format(6, "e.item_id")} * (n - m + 1)) AS p0, {_U.format(7, "e.item_id")} AS u1, {_U.format(8, "e.item_id")} AS u2 FROM eval_items e JOIN size s ON s.g = e.dataset),
b AS (SELECT *, CASE WHEN m < 2 THEN NULL WHEN floor(u1 * (n - m + 2)) = p0 THEN n - m + 1 ELSE floor(u1 * (n - m + 2)) END AS p1 FROM a),
c AS (SELECT *, CASE WHEN m < 3 THEN NULL WHEN floor(u2 * (n - m + 3)) IN (p0, p1) THEN n - m + 2 ELSE floor(u2 * (n - m + 3)) END AS p2 FROM b)
SELECT target, x.t || coalesce(chr(10) || y.t, '') || coalesce(chr(10) || z.t, '') || chr(10) || q AS prompt
FROM c JOIN pool x ON x.g = c.g AND x.k = p0 LEFT JOIN pool y ON y.g = c.g AND y.k = p1 LEFT JOIN pool z ON z.g = c.g AND z.k = p2""")
def fewshot_format(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "eval_items")
    targets = items.select(F.col("dataset").alias("g"), F.col("item_id").alias("target"), F.col("question").alias("q"))
    pool = items.select(F.col("dataset").alias("g"), "item_id", F.concat("question", F.lit(" = "), "split").alias("t"))
    drawn = mix.support(targets, pool, "g", "target", "item_id", 3, 5)
    shots = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "t"))), lambda x: x["t"]), "\n")
    return drawn.groupBy("target", "q").agg(shots.alias("s")).select("target", F.concat("s", F.lit("\n"), "q").alias("prompt"))


_TAGGED = "question || '<tool_call>{{\"name\": \"find\", \"arguments\": {{\"n\": ' || coalesce(CAST(rec_id AS VARCHAR), '') || '}}}}</tool_call>'".replace("{{", "{").replace("}}", "}")


@query(f"SELECT rec_id, 'find' AS name, CAST(rec_id AS VARCHAR) AS n FROM (SELECT rec_id, {_TAGGED} AS t FROM vqa_records) WHERE t IS NOT NULL")
def tool_extract_qwen(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat("question", F.lit('<tool_call>{"name": "find", "arguments": {"n": '), F.col("rec_id").cast("string"), F.lit("}}</tool_call>"))
    calls = table(spark, d, "vqa_records").select("rec_id", F.explode(tools.extracted_tags(text)).alias("c"))
    return calls.select("rec_id", F.col("c.name").alias("name"), F.get_json_object("c.arguments", "$.n").alias("n"))


@query("""SELECT rec_id, 'count_objects' AS name, CAST(length(question) AS VARCHAR) AS n FROM vqa_records WHERE question IS NOT NULL""")
def tool_extract_default(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat(F.lit('Action: count_objects\nAction Input: {"n": '), F.length("question").cast("string"), F.lit("}"))
    calls = table(spark, d, "vqa_records").select("rec_id", F.explode(tools.extracted_actions(text)).alias("c"))
    return calls.select("rec_id", F.col("c.name").alias("name"), F.get_json_object("c.arguments", "$.n").alias("n"))


@query("SELECT rec_id, ltrim(answer, chr(10)) AS text FROM vqa_records WHERE question IS NOT NULL AND answer IS NOT NULL")
def thought_strip(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "vqa_records").where("question is not null and answer is not null")
    return rows.select("rec_id", T.without_thought(F.concat(F.lit("<think>\n"), "question", F.lit("\n</think>\n\n"), "answer")).alias("text"))


@query(f"""WITH {DIALOGUES} SELECT ann_id, '<|im_start|>system' || chr(10) || CASE WHEN sys <> '' THEN sys ELSE 'You are Qwen, created by Alibaba Cloud. You are a helpful assistant.' END || '<|im_end|>' || chr(10) ||
 array_to_string(list_transform(turns, lambda t: CASE t.role WHEN 'user' THEN '<|im_start|>user' || chr(10) || t.content || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) ELSE t.content || '<|im_end|>' || chr(10) END), '') AS text
 FROM roled WHERE valid""")
def template_render(spark: SparkSession, d: str) -> DataFrame:
    rows = A.valid(aligned(spark, d))
    return rows.select("ann_id", F.array_join(T.render(T.resolve("qwen"), F.concat("_prompt", "_response"), F.col("_system")), "").alias("text"))


def _sql_text(slot: str, content: str) -> str:
    """A slot around a content, in SQL."""
    before, _, after = slot.replace("{bos}", "<s>").replace("{eos}", "</s>").replace("{{idx}}", "0").partition("{{content}}")
    return f"{_quoted(before)} || {content} || {_quoted(after)}"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _one_turn_sql(t: T.Template) -> str:
    head = _sql_text(t.system, _quoted(t.default_system)) if t.default_system else "''"
    prefix = _quoted(t.prefix.replace("{bos}", "<s>").replace("{eos}", "</s>"))
    lead, question = (prefix, f"({head} || question)") if t.system_in_user else (f"{prefix} || {head}", "question")
    return f"SELECT item_id, {_quoted(t.name)} AS template, {lead} || {_sql_text(t.user, question)} || {_sql_text(t.assistant, 'passage')} AS text FROM eval_items"


@query(" UNION ALL ".join(_one_turn_sql(t) for t in T.TEMPLATES.values()))
def template_all(spark: SparkSession, d: str) -> DataFrame:
    """A question and its answer in every template; system texts are the templates' own."""
    turn = lambda role, c: F.struct(F.lit(role).alias("role"), F.col(c).alias("content"))
    items = table(spark, d, "eval_items").select("item_id", F.array(turn("user", "question"), turn("assistant", "passage")).alias("m"))
    every = F.create_map(*[x for t in T.TEMPLATES.values() for x in (F.lit(t.name), F.array_join(T.render(t, F.col("m")), ""))])
    return items.select("item_id", F.explode(every).alias("template", "text"))


@query("SELECT name, file_name, formatting, columns_map['messages'] AS messages, columns_map['images'] AS images FROM dataset_registry")
def registry_entries(spark: SparkSession, d: str) -> DataFrame:
    return registry_frame(table(spark, d, "dataset_registry"))


# Tools


_NAME = "'find_' || regexp_replace(lower(name), '[^a-z0-9]', '', 'g')"
_TOOL = """'{"name": "' || n || '", "description": "' || f || '", "parameters": {"type": "object", "properties": {"image": {"type": "string", "description": "a path"}, "kind": {"type": "string", "enum": ["a", "b"]}}, "required": ["image"]}}'"""


def _indented(margin: int) -> str:
    """The tool as text indented by four, in SQL."""
    lines = [
        "{", "    \"name\": \"' || n || '\",", "    \"description\": \"' || f || '\",", '    "parameters": {', '        "type": "object",', '        "properties": {', '            "image": {', '                "type": "string",', '                "description": "a path"', "            },",
        '            "kind": {', '                "type": "string",', '                "enum": [', '                    "a",', '                    "b"', "                ]", "            }", "        },", '        "required": [', '            "image"', "        ]", "    }", "}",
    ]
    return "'" + ("\n" + " " * margin).join(lines) + "'"


def _offer_sql(offer: str, tools_sql: str, **slots: str) -> str:
    for name, sql in {"tools": tools_sql, **slots}.items():
        offer = offer.replace("{" + name + "}", "\x00" + name + "\x00", 1)
    parts = [tools_sql if p == "tools" else slots[p] if p in slots else _quoted(p) for p in offer.split("\x00")]
    return f"WITH t AS (SELECT name, {_NAME} AS n, file_name AS f FROM dataset_registry), j AS (SELECT *, {_TOOL} AS tool FROM t) SELECT name, {' || '.join(parts)} AS text FROM j"


def _tool_column() -> "F.Column":
    n = F.concat(F.lit("find_"), F.regexp_replace(F.lower("name"), "[^a-z0-9]", ""))
    spec = ', "parameters": {"type": "object", "properties": {"image": {"type": "string", "description": "a path"}, "kind": {"type": "string", "enum": ["a", "b"]}}, "required": ["image"]}}]'
    return F.concat(F.lit('[{"name": "'), n, F.lit('", "description": "'), "file_name", F.lit('"'), F.lit(spec))


_WRAPPED = """'{"type": "function", "function": ' || tool || '}'"""
_OFFERS = {
    "default": _offer_sql(tools.DEFAULT_OFFER, "'> Tool Name: ' || n || chr(10) || 'Tool Description: ' || f || chr(10) || 'Tool Args:' || chr(10) || '  - image (string, required): a path' || chr(10) || '  - kind (string): , should be one of [a, b]' || chr(10) || chr(10)", names="n"),
    "glm4": _offer_sql(tools.GLM4_OFFER, f"chr(10) || chr(10) || '## ' || n || chr(10) || chr(10) || {_indented(0)} || chr(10) || '在调用上述函数时，请使用 Json 格式表示调用的参数。'"),
    "llama3": _offer_sql(tools.LLAMA3_OFFER, "'{' || chr(10) || '    \"type\": \"function\",' || chr(10) || '    \"function\": ' || " + _indented(4) + " || chr(10) || '}' || chr(10) || chr(10)", date="'01 Jan 2025'"),
    "mistral": _offer_sql(tools.MISTRAL_OFFER, f"'[' || {_WRAPPED} || ']'"),
    "qwen": _offer_sql(tools.QWEN_OFFER, f"chr(10) || {_WRAPPED}"),
    "glm4_moe": _offer_sql(tools.GLM4_MOE_OFFER, f"chr(10) || {_WRAPPED}"),
    "seed_oss": _offer_sql(tools.SEED_OFFER, "chr(10) || '[' || tool || ']'"),
    "ling": _offer_sql(tools.LING_OFFER, f"chr(10) || {_WRAPPED}"),
}


def _register_offer(dialect: str, sql: str) -> None:
    def offer(spark: SparkSession, d: str) -> DataFrame:
        return table(spark, d, "dataset_registry").select("name", tools.offer_column(dialect, _tool_column(), "01 Jan 2025").alias("text"))

    offer.__name__ = f"tool_offer_{dialect}"
    query(sql)(offer)


for _dialect, _sql in _OFFERS.items():
    _register_offer(_dialect, _sql)


_ARGS = "'{\"n\": ' || rec_id || ', \"q\": ' || to_json(dataset) || '}'"
_CALL = f"""'{{"name": "find", "arguments": ' || {_ARGS} || '}}'"""
_WRITTEN = {
    "default": f"'Action: find' || chr(10) || 'Action Input: ' || {_ARGS}",
    "glm4": f"'find' || chr(10) || {_ARGS}",
    "llama3": f"""'{{"name": "find", "parameters": ' || {_ARGS} || '}}'""",
    "mistral": f"'[' || {_CALL} || ']'",
    "qwen": f"'<tool_call>' || chr(10) || {_CALL} || chr(10) || '</tool_call>'",
    "glm4_moe": "chr(10) || '<tool_call>find' || chr(10) || '<arg_key>n</arg_key>' || chr(10) || '<arg_value>' || rec_id || '</arg_value>' || chr(10) || '<arg_key>q</arg_key>' || chr(10) || '<arg_value>' || dataset || '</arg_value>'",
    "seed_oss": "chr(10) || '<seed:tool_call>' || chr(10) || '<function=find' || chr(10) || '<parameter=n>' || rec_id || '</parameter>' || chr(10) || '<parameter=q>' || dataset || '</parameter>' || chr(10) || '</function>' || chr(10) || '</seed:tool_call>'",
}


@query(" UNION ALL ".join(f"SELECT rec_id, '{name}' AS dialect, {sql} AS text FROM vqa_records WHERE dataset IS NOT NULL" for name, sql in _WRITTEN.items()))
def tool_calls_written(spark: SparkSession, d: str) -> DataFrame:
    args = F.concat(F.lit('{"n": '), F.col("rec_id").cast("string"), F.lit(', "q": "'), F.regexp_replace(F.regexp_replace("dataset", r"\\", r"\\\\"), '"', r'\\"'), F.lit('"}'))
    call = F.concat(F.lit('{"name": "find", "arguments": '), args, F.lit("}"))
    rows = table(spark, d, "vqa_records").where("dataset is not null").select("rec_id", call.alias("call"))
    parts = [rows.select("rec_id", F.lit(name).alias("dialect"), tools.write_column(name, F.col("call")).alias("text")) for name in _WRITTEN]
    return reduce(DataFrame.unionByName, parts)


@query("SELECT rec_id, x.dialect, CAST(rec_id AS VARCHAR) AS n, dataset AS q FROM vqa_records, (SELECT unnest(['default', 'glm4', 'llama3', 'mistral', 'qwen']) AS dialect) x WHERE dataset IS NOT NULL")
def tool_calls_read(spark: SparkSession, d: str) -> DataFrame:
    """What is written is read back, by every dialect that has a reader of its own output."""
    written = tool_calls_written(spark, d)
    parts = [written.where(F.col("dialect") == name).select("rec_id", "dialect", tools.read_column(name, F.col("text")).alias("calls")) for name in ("default", "glm4", "llama3", "mistral", "qwen")]
    calls = reduce(DataFrame.unionByName, parts)
    return calls.select("rec_id", "dialect", F.get_json_object("calls", "$[0].arguments.n").alias("n"), F.get_json_object("calls", "$[0].arguments.q").alias("q"))

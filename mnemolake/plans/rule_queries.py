"""Registered queries over the rule tables. Their SQL lists the rules once more, apart from
the tables of functions/rules.py, so an entry lost there fails here.

The driver's conversations hold no rule's words: messages get an opener, by their number,
and a third of them are cut short, alike in both engines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mnemolake.functions import rules as R
from mnemolake.functions import text as T
from mnemolake.plans.queries import Col, query
from mnemolake.plans.views import table

OPENERS = (
    "", "wrong ", "不对 ", "next ", "new topic: ", "那么 ", "also this ", "换个新的话题 ", "forget that, ", "no, that's incorrect. ", "hi", "What did we say on ", "总结一下我们 ", "please ", "帮我 写 ", "/memory ",
    "use tabs instead of spaces. ", "I prefer tea over coffee!\n", "next time: ", "it should be 42 or ", "almost ", "you must keep ", "make sure to end ", "别忘了 备份 ", "I don't understand ", "delete ", "then run ", "thanks ", "what?? ",
    "TypeError: x is not a function\n", "error: cannot open\n", "lib/a.so: file not found here\n", "ENV_NOT_SET and EACCES_DENIED ", "exit code: 127\n503 Service Unavailable ", "value must be under 100 ", "the prime factor of a triangle in SQL, docker and k8s ",
    "pip npm sqlite sql shell git python .ts rust plugin http dns token jest error ", "这个 和 那些 类似 吗 ", "应该是 七十 ", "不是 三, 是 四 ", "加一个 时间 限制 ", "不要 空格, 用 制表符\n", "result is 17 ", "kubectl exited; select 1 ",
)


def _said() -> Column:
    """A message with its opener."""
    opener = F.element_at(F.array(*map(F.lit, OPENERS)), (Col("conv_id") * 7 + Col("turn")).cast("int") % len(OPENERS) + 1)
    return F.concat(opener, F.when(Col("conv_id") % 3 == 0, F.substring("text", 1, 30)).otherwise(Col("text")))


_LIST = ", ".join("'" + o.replace("'", "''").replace("\n", "' || chr(10) || '") + "'" for o in OPENERS)
SAID = f"said AS (SELECT conv_id, turn, role, [{_LIST}][((conv_id * 7 + turn) % {len(OPENERS)})::INT + 1] || CASE WHEN conv_id % 3 = 0 THEN left(text, 30) ELSE text END AS t FROM conversations)"


@query(rf"""WITH {SAID}, k(p, tag) AS (VALUES ('\bmath(?:ematics)?\b|\bolympiad\b|\bcompetition\b', 'math'), ('\breason(?:ing)?\b|\bproblem[-\s]?solving\b|\bderive\b|\bprove\b|\bcompute\b', 'reasoning'),
('\bcombinatorics?\b|\bcount(?:ing)?\b|\bprobability\b|\bpermutation\b|\bcombination\b|\bbijection\b', 'combinatorics'), ('\bgeometry\b|\btriangle\b|\bcircle\b|\bpolygon\b|\bangle\b|\bmidpoint\b|\bray\b|\bparallel\b', 'geometry'),
('\bnumber theory\b|\bmod(?:ulo|ular)?\b|\bprime\b|\bfactor(?:ization)?\b|\bdivisib(?:le|ility)\b|\bcongruence\b', 'number_theory'), ('\balgebra\b|\bpolynomial\b|\bequation\b|\bfunctional equation\b|\bsystem of equations\b', 'algebra'),
('\bdocker\b|\bcontainer\b', 'docker'), ('\bkubernetes\b|\bkubectl\b|\bk8s\b', 'kubernetes'), ('\bpip\b|\brequirements\.txt\b', 'pip'), ('\bnpm\b|\byarn\b|\bpnpm\b|\bpackage\.json\b', 'npm'), ('\bsqlite\b|\bpostgres\b|\bmysql\b|\bdatabase\b', 'database'),
('\bsql\b|\bselect\s|\binsert\s', 'sql'), ('\bshell\b|\bbash\b|\bzsh\b|\bterminal\b', 'shell'), ('\bgit\b|\bcommit\b|\bmerge\b|\bbranch\b', 'git'), ('\bpython\b|\.py\b', 'python'), ('\btypescript\b|\.ts\b|\.tsx\b', 'typescript'), ('\bjavascript\b|\.js\b|\.jsx\b', 'javascript'),
('\brust\b|\bcargo\b|\.rs\b', 'rust'), ('\bplugin\b', 'plugin'), ('\bapi\b|\brest\b|\bhttp\b', 'http'), ('network|\bdns\b|\bproxy\b', 'network'), ('\bauth(entication|orization)?\b|\btoken\b|\boauth\b', 'auth'), ('\btest\b|\bunit test\b|\bjest\b|\bvitest\b|\bpytest\b', 'test'), ('\berror\b|\bexception\b|\btraceback\b', 'error'))
SELECT conv_id, turn, coalesce(string_agg(tag, ',' ORDER BY tag), '') AS tags FROM said LEFT JOIN k ON regexp_matches(t, '(?i)' || p) AND regexp_matches(tag, '^[a-z0-9][a-z0-9+]*$') GROUP BY 1, 2""")
def text_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(R.keyword_tags(_said()), ",").alias("tags"))


@query(rf"""WITH {SAID}, k(i, p, tag) AS (VALUES (1, '\bdocker\b|\bcontainer\b', 'docker'), (2, '\bkubernetes\b|\bkubectl\b|\bk8s\b', 'kubernetes'), (3, '\bpip\b|\bpip install\b|\brequirements\.txt\b', 'pip'), (4, '\bnpm\b|\byarn\b|\bpnpm\b|\bpackage\.json\b', 'npm'),
(5, '\bsqlite\b|\bpostgres\b|\bpostgresql\b|\bmysql\b|\bdatabase\b', 'database'), (6, '\bsql\b|\bselect\s|\binsert\s', 'sql'), (7, '\bshell\b|\bbash\b|\bzsh\b|\bterminal\b', 'shell'), (8, '\bgit\b|\bcommit\b|\bmerge\b|\bbranch\b', 'git'), (9, '\bpython\b|\.py\b', 'python'), (10, '\btypescript\b|\.ts\b|\.tsx\b', 'typescript'),
(11, '\bjavascript\b|\.js\b|\.jsx\b', 'javascript'), (12, '\brust\b|\bcargo\b|\.rs\b', 'rust'), (13, '\bplugin\b', 'plugin'), (14, '\bapi\b|\brest\b|\bhttp\b', 'http'), (15, 'network|\bdns\b|\bproxy\b', 'network'), (16, '\bauth(entication|orization)?\b|\btoken\b|\boauth\b', 'auth'), (17, '\btest\b|\bunit test\b|\bjest\b|\bvitest\b|\bpytest\b', 'test'),
(18, '\berror\b|\bexception\b|\btraceback\b|\bstack trace\b', 'error')),
b AS (SELECT conv_id, turn, t, CASE WHEN turn % 2 = 0 THEN [role, 'net', 'timeout'] ELSE [role] END AS own FROM said), h AS (SELECT conv_id, turn, own, tag, row_number() OVER (PARTITION BY conv_id, turn ORDER BY i) AS n FROM b JOIN k ON regexp_matches(t, '(?i)' || p)),
a AS (SELECT conv_id, turn, tag FROM h WHERE n <= 8 - len(own) UNION ALL SELECT conv_id, turn, unnest(own) FROM b) SELECT conv_id, turn, string_agg(tag, ',' ORDER BY tag) AS tags FROM a GROUP BY 1, 2""")
def capture_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each message as a step with one tool, whose name starts with the role."""
    tool = F.struct(F.concat(F.lit(" "), F.initcap("role"), F.lit(".Call-"), Col("turn").cast("string")).alias("name"), F.when(Col("turn") % 2 == 0, "E_NET_TIMEOUT").alias("error_code"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(R.capture_tags(F.array(tool), _said(), F.lit(None).cast("string")), ",").alias("tags"))


@query(rf"""WITH {SAID}, u AS (SELECT *, lag(t) OVER w AS prev, (turn * 17 % 150)::BIGINT * 60000 AS gap, CASE WHEN turn % 4 = 0 THEN ['Deploy', 'trace'] WHEN turn % 4 = 1 THEN ['trace', 'of'] END AS tags FROM said WHERE role = 'user' WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
x AS (SELECT *, CASE WHEN turn % 3 = 0 THEN 'you wrote: ' || trim(t) || ' and so on' ELSE 'short' END AS answer FROM u),
y AS (SELECT *, trim(t) AS m, list_filter(string_split_regex(trim(answer), '\s+'), lambda w: length(w) >= 3) AS ws FROM x),
r AS (SELECT *, regexp_matches(m, '^不对|^错了|^重做|^改一下|^再来一次|^重新|^而不是') OR regexp_matches(m, '(?i)^\s*wrong\b|^\s*incorrect\b|^\s*not (what|quite|right|correct)\b|^\s*no[,.]?\s+(that''?s\s+)?(wrong|incorrect|not right)|^\s*redo\b|^\s*try again\b') AS r1,
length(trim(answer)) >= 20 AND len(ws) >= 8 AND len(list_filter(range(1, len(ws) - 6), lambda i: length(array_to_string(ws[i:i + 7], ' ')) > 24 AND contains(lower(m), lower(array_to_string(ws[i:i + 7], ' '))))) > 0 AS r2,
length(m) <= 60 AND regexp_matches(m, '^[那这它其还哪啥]') AS r3,
regexp_matches(m, '再(帮)?我|下一个|另一个类似|(这本|这些|这个|这种|这类|上述|前面|刚才|刚刚).{{0,20}}(相似|类似|相关|推荐|还有|其他|别的|哪些|什么)|(相似|类似|相关).{{0,20}}(这本|这些|这个|这种|这类|上述|前面|刚才|刚刚)|(还有|有没有|有什么).{{0,20}}(其他|别的|类似|相似|相关|推荐)') OR regexp_matches(m, '(?i)\bnext\b|\bthen\b|\balso\b|\banother (similar|one)\b|\b(these|those|this|that|similar|related)\b|\bmore of (that|this)\b') AS r4,
regexp_matches(m, '换个(话题|问题|任务|主题|场景)|换个[^\s。,，！!?？]{{1,6}}(话题|问题|任务|主题|场景)|换下(一)?个[^\s。,，！!?？]{{0,6}}(话题|问题|任务|主题|场景)?|^\s*下一?个(\S{{0,5}})?(话题|问题|任务|主题|场景)|现在(帮我)?处理另一个|先放下|忘掉之前') OR regexp_matches(m, '(?i)\bnew (task|question|topic|subject)\b|\bforget (that|about it)\b|\bchange (of )?(topic|subject|task)\b|\bmoving on\b|\bnext (task|topic|question)\b') AS r5,
gap > 1800000 AS r6, coalesce(list_contains(tags, 'Deploy') AND NOT contains(lower(m), 'deploy'), false) AS r7 FROM y)
SELECT conv_id, turn, CASE WHEN m = '' THEN 'unknown' WHEN coalesce(prev, '') = '' OR gap > 7200000 OR r5 THEN 'new_task' WHEN r1 THEN 'revision' WHEN r3 OR r4 THEN 'follow_up' WHEN r2 THEN 'revision' ELSE 'follow_up' END AS relation,
CASE WHEN m = '' THEN 0.0::DOUBLE WHEN coalesce(prev, '') = '' THEN 0.75::DOUBLE WHEN gap > 7200000 THEN 0.9::DOUBLE WHEN r5 OR r1 OR r3 THEN 0.85::DOUBLE WHEN r4 THEN 0.8::DOUBLE WHEN r2 THEN 0.75::DOUBLE WHEN r6 OR r7 THEN 0.55::DOUBLE ELSE 0.5::DOUBLE END AS confidence,
CASE WHEN m = '' THEN 'empty' WHEN coalesce(prev, '') = '' THEN 'bootstrap' WHEN gap > 7200000 THEN 'idle_timeout' WHEN r5 THEN 'r5_new_phrase' WHEN r1 THEN 'r1_negation_keyword' WHEN r3 THEN 'r3_pronoun_ref' WHEN r4 THEN 'r4_follow_phrase' WHEN r2 THEN 'r2_quotes_prev' WHEN r6 THEN 'r6_time_gap,weak_new_task_fallback' WHEN r7 THEN 'r7_domain_shift,weak_new_task_fallback' ELSE 'default_follow_up' END AS signals FROM r""")
def turn_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' turns to the ones before; every third answer is one that the turn quotes."""
    c = table(spark, sf_dir, "conversations").filter("role = 'user'").withColumn("t", _said())
    answer = F.when(Col("turn") % 3 == 0, F.concat(F.lit("you wrote: "), F.trim("t"), F.lit(" and so on"))).otherwise("short")
    tags = F.when(Col("turn") % 4 == 0, F.array(F.lit("Deploy"), F.lit("trace"))).when(Col("turn") % 4 == 1, F.array(F.lit("trace"), F.lit("of")))
    r = R.turn_relation(Col("t"), F.lag("t").over(W.partitionBy("conv_id").orderBy("turn")), Col("turn") * 17 % 150 * 60000, answer, tags)
    told = c.select("conv_id", "turn", r.alias("r"))
    return told.select("conv_id", "turn", "r.relation", "r.confidence", F.array_join("r.signals", ",").alias("signals"))


@query(rf"""WITH {SAID}, m AS (SELECT *, trim(t) AS m FROM said), k AS (SELECT *, CASE WHEN m = '' THEN 1 WHEN regexp_matches(m, '(?i)^\s*/(memory|memo)\b') THEN 2
WHEN length(m) <= 48 AND (regexp_matches(lower(m), '^(hi|hello|hey|yo|sup|thanks|thank you|ok|okay|cool|nice)[\s!.?]*$') OR regexp_matches(m, '^(你好|在吗|在不在|谢谢|谢啦|好的|收到|ok 的|好啊)[\s!。？]*$')) THEN 3
WHEN regexp_matches(m, '(?i)\b(what did (i|we) (say|discuss|talk|mention)|do you remember|last time|earlier we|previously we|we talked about)\b') OR regexp_matches(m, '我们(刚刚|之前|刚才)?(聊|说|讨论)过|你还记得|上次(?:我们)?|之前(?:我|我们|咱们)?(提|说|聊|讨论)') OR regexp_matches(m, '回忆|回顾|总结(一下)?我们|帮我(想|回忆)') THEN 4
WHEN regexp_matches(m, '(?i)^(please|pls)\s+|^(write|build|create|fix|debug|run|install|refactor|add|remove|delete|generate|set up|analyze|review|test|deploy|implement|translate|explain)\b') OR regexp_matches(m, '^(帮(我)?|请|麻烦|给我|替我)\s*(写|做|生成|实现|修复|调试|运行|安装|部署|优化|重构|添加|删除|查看|检查|分析|翻译)') THEN 5
WHEN CASE WHEN regexp_matches(m, '[一-鿿㐀-䶿]') THEN len(regexp_extract_all(m, '[一-鿿㐀-䶿]|[0-9A-Za-z_]')) ELSE len(regexp_extract_all(m, '[^\s]+')) END >= 40 THEN 6 ELSE 7 END AS n FROM m)
SELECT conv_id, turn, ['chitchat', 'meta', 'chitchat', 'memory_probe', 'task', 'task', 'unknown'][n] AS intent, [0.9, 0.98, 0.9, 0.88, 0.75, 0.6, 0.4][n]::DOUBLE AS confidence, ['empty', 'meta.command_prefix', 'chitchat.greeting', 'memory.past_reference', 'task.imperative_verb', 'task.long_freeform', 'default_unknown'][n] AS signal, ['', '', '', '12', '123', '123', '123'][n] AS tiers FROM k""")
def intents(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = table(spark, sf_dir, "conversations").select("conv_id", "turn", R.intent(_said()).alias("i"))
    plan = told.withColumn("p", R.intent_tiers(Col("i.kind")))
    tiers = F.concat_ws("", *[F.when(Col(f"p.tier{k}"), str(k)) for k in (1, 2, 3)])
    return plan.select("conv_id", "turn", Col("i.kind").alias("intent"), "i.confidence", "i.signal", tiers.alias("tiers"))


_CLEAN = lambda p, g: rf"""trim(regexp_replace(trim(regexp_extract(m, '{p}', {g})), '^["''`]|["''`]$', '', 'g'))"""
_PREFER = ((r"(?i)use\s+(.+?)\s+instead\s+of\s+(.+?)([.。!?\n]|$)", 1, 2), (r"(?i)prefer\s+(.+?)\s+over\s+(.+?)([.。!?\n]|$)", 1, 2), (r"(?i)([^,.!?\n]+)\s+instead\s+of\s+([^,.!?\n]+)", 1, 2), (r"用\s*(.+?)\s*(代替|而不是)\s*(.+?)([。!?\n]|$)", 1, 3), (r"(别|不要|不能)\s*(.+?)[，,]\s*(要)?\s*(用|改用)\s*(.+?)([。!?\n]|$)", 5, 2), (r"(?i)next time\s*[:：]?\s*(.+)", 1, 0))
_CORRECT = (r"(?i)\b(?:it\s+should\s+be|should\s+be|it\s*''?s?\s+actually)\s+(.{3,120})", r"(?i)\bnot\s+.{2,80}[,，]\s*(?:it''?s\s+|its\s+|actually\s+)?(.{3,120})", r"(?i)\b(?:answer|result|value|output)\s+(?:is|=)\s+(.{2,120})", r"应该是\s*(.{2,80})", r"不是\s*.{1,40}\s*[，,]?\s*是\s*(.{2,80})")
_HOLD = (r"(?i)\b(?:also|additionally|on top of that)\s+(.{3,120})", r"(?i)\b(?:must|has to|needs to)\s+(.{3,120})", r"(?i)\bmake sure (?:to |that )?(.{3,120})", r"(?i)\bbut\s+(?:make sure|don''?t forget|keep)\s+(.{3,120})", r"还要\s*(.{2,80})", r"别忘了\s*(.{2,80})", r"加(?:一个|个)?\s*(.{2,80}(?:条件|限制|要求|约束))", r"必须\s*(.{2,80})")
_SHAPES = " ".join(
    [f"WHEN {_CLEAN(p, a)} <> ''" + (f" OR {_CLEAN(p, b)} <> ''" if b else "") + f" THEN 'preference|0.8|' || {_CLEAN(p, a)} || '|' || " + (_CLEAN(p, b) if b else "''") for p, a, b in _PREFER]
    + ["WHEN regexp_matches(l, 'prefer|instead|should use|下次用|改用|而不是') THEN CASE WHEN neg THEN 'preference|0.75||' ELSE 'preference|0.55||' END"]
    + [f"WHEN {_CLEAN(p, 1)} <> '' THEN 'correction|0.75|' || {_CLEAN(p, 1)} || '|'" for p in _CORRECT]
    + [r"WHEN regexp_matches(l, '\b(?:not quite|close but|almost|kind of)\b') THEN 'correction|0.5||'"]
    + [f"WHEN {_CLEAN(p, 1)} <> '' THEN 'constraint|0.7|' || {_CLEAN(p, 1)} || '|'" for p in _HOLD]
)


@query(rf"""WITH {SAID}, a AS (SELECT *, trim(t) AS m, lower(trim(t)) AS l FROM said), m AS (SELECT *, regexp_matches(l, '\bwrong\b|\bnot\s+(right|correct|what|that)\b|\bdon''t\s+do\b|\bdo\s+not\s+do\b|\bstop\s+that\b|\bno[,.!? ]|^(no|nope|nah)$|不对|错(了)?|不要这样|别这样') AS neg FROM a)
SELECT conv_id, turn, CASE WHEN m = '' THEN 'unknown|0.0||' {_SHAPES} WHEN neg THEN 'negative|0.75||' WHEN regexp_matches(l, '\b(great|perfect|awesome|nice work|well done|works|fixed)\b|\bthanks?\b|^(yes|ok|okay|sure)[.!?]?$|好的|太棒了|不错|完美|搞定') THEN 'positive|0.75||'
WHEN regexp_matches(l, '\bwhat\s+(do\s+you\s+mean|are\s+you\s+(doing|saying))\b|\bwhy\s+(did|are)\s+you\b|\bi\s+don''?t\s+(understand|get|follow)\b|\bnot\s+sure\s+what\b|\bconfus(ed|ing)\b|什么意思|没(看|搞)懂|为什么(这样|要)|\?{{2,}}\s*$') THEN 'confusion|0.7||'
WHEN lower(regexp_extract(m, '[A-Za-z一-鿿]+')) IN ('run', 'delete', 'create', 'install', 'try', 'use', 'call', 'build', 'deploy', 'test', 'add', 'remove', 'restart', '停止', '启动', '运行', '删除', '创建', '安装', '试试', '改成') OR regexp_matches(l, '\b(then|also|next)\s+(run|delete|create|install|try|use|call)\b') THEN 'instruction|0.55||'
ELSE 'unknown|0.3||' END AS shape FROM m""")
def feedback_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """shape|confidence|what is preferred, correct or required|what is to be avoided."""
    told = table(spark, sf_dir, "conversations").select("conv_id", "turn", R.feedback_shape(_said()).alias("f"))
    blank = lambda c: F.coalesce(c, F.lit(""))
    return told.select("conv_id", "turn", F.concat_ws("|", "f.shape", Col("f.confidence").cast("string"), blank(F.coalesce("f.prefer", "f.correction", "f.constraint")), blank(Col("f.avoid"))).alias("shape"))


_ERRORS = (
    r"\b([A-Z][A-Za-z0-9]*(?:Error|Exception)):\s*([^\n]{4,160})", r"\b(?:error|Error|fatal|FATAL|ERROR)\s*:\s*([^\n]{4,160})",
    r"\b([A-Za-z0-9_\-./]+):\s*[^\n]{0,40}\b(not found|no such (?:file|directory)|permission denied|undefined reference|command not found)\b[^\n]*",
    r"\b([A-Za-z0-9_\-./]{3,80})\s+[^\n]{0,40}\b(not found|no such (?:file|directory)|permission denied|undefined reference|command not found)\b[^\n]*",
    r"\b([A-Za-z0-9_]{3,40})\s+(is required|must be|cannot|could not|failed to)\s+[^\n]{3,120}", r"\bexit (?:code|status)\s*[:=]?\s*(\d{1,4})\b[^\n]{0,80}", r"\b(4\d\d|5\d\d)\s+([A-Za-z][A-Za-z ]{2,30})\b", r"\b([A-Z][A-Z0-9_]{2,}_[A-Z0-9_]+)\b",
)


@query(rf"""WITH {SAID}, c AS (SELECT conv_id, turn, flatten([{", ".join(f"regexp_extract_all(t, '{p}')" for p in _ERRORS)}]) AS fs FROM said), f AS (SELECT conv_id, turn, unnest(fs) AS f, generate_subscripts(fs, 1) AS i FROM c),
n AS (SELECT conv_id, turn, i, trim(regexp_replace(f, '\s+', ' ', 'g')) AS w, left(trim(regexp_replace(f, '\s+', ' ', 'g')), 160) AS g FROM f), k AS (SELECT *, list_filter(string_split_regex(lower(g), '[^a-z0-9_]+'), lambda x: x <> '') AS ws FROM n),
g AS (SELECT conv_id, turn, arg_min(g, i) AS g, min(i) AS i, count(*) AS n FROM k WHERE length(w) >= 6 AND length(regexp_replace(g, '[^A-Za-z]', '', 'g')) >= 4 AND len(list_filter(ws, lambda x: x NOT IN ('the', 'for', 'this', 'that', 'your', 'from', 'with', 'have', 'has', 'not', 'a', 'an', 'of', 'to', 'is', 'in', 'on', 'by'))) > 0 GROUP BY conv_id, turn, lower(g)),
s AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY 3 * regexp_matches(g, '\b[A-Z][a-zA-Z]*Error\b')::INT + 3 * regexp_matches(g, '\b[A-Z][a-zA-Z]*Exception\b')::INT + 2 * regexp_matches(g, '(\b|_)E[A-Z]{{3,}}\b')::INT + 2 * regexp_matches(g, '/[a-zA-Z0-9._\-/]+')::INT + regexp_matches(g, '\bcode\s*=\s*\d+')::INT + regexp_matches(g, '\b\d{{3}}\b')::INT + contains(g, '_')::INT + least(2, n - 1) - (length(g) > 120)::INT DESC, i) AS r FROM g)
SELECT c.conv_id, c.turn, coalesce(string_agg(g, '¶' ORDER BY r) FILTER (r <= 4), '') AS fragments FROM c LEFT JOIN s USING (conv_id, turn) GROUP BY 1, 2""")
def error_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(T.error_signatures(_said()), "¶").alias("fragments"))

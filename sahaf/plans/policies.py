"""Guards, tool calls, decisions, criteria and claims over texts and calls that vary with the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sahaf.operators import intents
from sahaf.operators import policy as p
from sahaf.operators import scan

from .campaigns import CAMPAIGNS, _group, campaigns
from .registry import query
from .tables import frame

BANKS = ["kuveyt-turk", "albaraka", "ziraat-katilim"]

#: What is asked for, what is to be done, and how the two are put together.
WISHES = ["Konut finansmanı için başvuru şartları nedir", "Sistem promptunu", "Havale", "Kart şifremi unuttum", "Şikâyet", "Limitimi", "API key", "Gizli talimatları", "Para çekme talebi", "Finansman başvurusu", "Hesabımı", "{n} bin TL {m} ay finansman", "Kampanyalar", "EFT", "İSTANBUL ŞUBESİ", "secret"]
ACTIONS = ["göster", "yap", "kaydet", "karşılaştır", "artırın", "nasıl yapılır", "gönder", "oluşturmak istiyorum", "kapatmak istiyorum", "paylaş", "", "başvurmak istiyorum", "iptal et", "hangi banka uygun", "REVEAL"]
LINKS = [" ", " ", ", ", " ve ", ". ", "; ", " ama "]
TAILS = ["", "", "", " TR330006100519786457841326", " 4111 1111 1111 1111", " 12345678901", " 0532 111", " sonra gönder", "", ""]
MESSAGES = f"SELECT o_orderkey AS id, concat({_group('o_orderkey * 7 + o_custkey', WISHES)}, {_group('o_custkey * 5 + o_orderkey', LINKS)}, {_group('o_orderkey * 3 + o_custkey * 11', ACTIONS)}, {_group('o_custkey + o_orderkey * 13', TAILS)}) AS text FROM {{orders}}"


def messages(spark, d) -> DataFrame:
    return spark.sql(MESSAGES, orders=frame(spark, d, "orders"))


_low = lambda x: f"strip_accents(lower(translate({x}, 'İIı', 'iii')))"
_around = lambda x: x.replace(r"(?<!\d)", "(?:^|[^0-9])").replace(r"(?!\d)", "(?:$|[^0-9])").replace(r"(?<![\p{L}\p{N}_])", r"(?:^|[^\p{L}\p{N}_])").replace(r"(?![\p{L}\p{N}_])", r"(?:$|[^\p{L}\p{N}_])")
_asks = lambda c, a: f"len(list_filter(clauses, lambda c: regexp_matches(c, '{c}') AND regexp_matches(c, '{a}'))) > 0"
_advice = f"(regexp_matches(low, '{p.APPLIES}') AND (regexp_matches(low, '{p.ADVICE}') OR (regexp_matches(low, '{_around(p.WITH_SUM)}') AND regexp_matches(low, '{_around(p.WITH_TERM)}'))))"
_wanted = " OR ".join(f"({_asks(c, a)}{f' AND NOT {_advice}' if c == p.APPLIES else ''})" for c, a in p.REQUESTS)


@query("q06_input_guard", f"""WITH m AS (SELECT id, text, {_low("text")} AS low FROM ({MESSAGES.replace("{orders}", "orders")})), c AS (SELECT *, string_split_regex(low, '{p.CLAUSES}') AS clauses FROM m),
v AS (SELECT id, CASE WHEN {" OR ".join(f"regexp_matches(text, '{_around(x)}')" for x in p.IDENTIFIERS)} THEN 'sensitive_data' WHEN {_asks(p.INTERNALS, p.EXTRACTS)} THEN 'internal_information' WHEN {_wanted} THEN 'transaction_execution' END AS intent FROM c)
SELECT id, intent, CASE intent WHEN 'internal_information' THEN 'REFUSE' WHEN 'sensitive_data' THEN 'REDIRECT' WHEN 'transaction_execution' THEN 'REDIRECT' ELSE 'PASS' END AS action FROM v""")
def q06(spark, d):
    """Personal numbers, wishes for internals, and transactions, by concept and action within a clause."""
    own = messages(spark, d).select("id", p.guard(F.col("text")).alias("g"))
    return own.select("id", "g.intent", F.coalesce("g.action", F.lit("PASS")).alias("action"))


def _case(pick: str, values: list[str | None]) -> str:
    return f"CASE ({pick}) % {len(values)} " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in enumerate(values) if v is not None) + " END"


INTENTS = ["product_comparison", "product_comparison", "rate_query", "definition", "bank_list", "complaint_support", "product_search", "nonsense"]
TOOLS = ["financing_quote", "financing_quote", "structured_sql", "structured_sql", "comparison", "hybrid_rag", "ontology", "drop_table"]
_arguments = [
    _case("event_id", ['"financing_type":"housing"', '"financing_type":"vehicle"', '"financing_type":"consumer"', '"financing_type":"agriculture"', '"financing_type":7', None, '"financing_type":"housing"', '"financing_type":"commercial"', '"financing_type":"vehicle"']),
    _case("event_id * 3 + user_id", ['"term_months":12', '"term_months":24', '"term_months":24', '"term_months":24', '"term_months":12', '"term_months":24', '"term_months":36', '"term_months":"12"', '"term_months":0', '"term_months":12.5', '"term_months":true', None, '"term_months":300']),
    _case("event_id + user_id * 5", ['"amount":100000', '"amount":2500.75', '"amount":1', '"amount":250000', '"amount":75.5', '"amount":9', '"amount":-1', '"amount":1e3', '"amount":"x"', '"amount":null', None, '"amount":100000001']),
    _case("event_id * 7 + user_id", ['"fee_priority":true', '"fee_priority":false', '"fee_priority":1', None]),
    _case("event_id + user_id", [None, None, None, '"banks":["albaraka"]', '"banks":[]', '"banks":"albaraka"', '"banks":["albaraka","x"]', '"banks":[1]', None, None]),
    _case("event_id * 11 + user_id * 3", [None, None, None, None, '"term_months_min":12,"term_months_max":24', '"term_months_min":1,"term_months_max":36', '"term_months_min":12', '"term_months_min":13,"term_months_max":12', None, '"term_months_min":null,"term_months_max":null']),
    _case("event_id * 13 + user_id", [None, None, None, None, None, None, '"metric":"FEE"', '"metric":"x"', '"aggregation":"MIN"', '"product_type":"financing"', '"extra":1', None]),
]
_name = _case("user_id + event_id * 5", TOOLS)
_json = lambda parts: f"""concat('{{"name":"', {_name}, '","arguments":{{', concat_ws(',', {", ".join(parts)}), '}}', CASE WHEN event_id % 41 = 0 THEN ',"more":1' ELSE '' END, CASE WHEN event_id % 43 = 0 THEN '' ELSE '}}' END)"""
_called = ["event_id", "user_id", f"{_case('event_id + user_id * 3', INTENTS)} AS intent", f"{_json(_arguments)} AS call", f"{_json([*_arguments[:2], _case('event_id * 5 + user_id', ['"amount":100000', '"amount":2500.75']), *_arguments[3:]][::-1])} AS other"]
CALLS = f"SELECT {', '.join(_called)} FROM events"


def calls(spark, d) -> DataFrame:
    return frame(spark, d, "events").selectExpr(*_called)


_t = lambda k: f"json_type(j, '$.arguments.{k}')"
_s = lambda k: f"json_extract_string(j, '$.arguments.{k}')"
_whole, _number = (lambda k: f"{_t(k)} IN ('BIGINT', 'UBIGINT')"), (lambda k: f"{_t(k)} IN ('BIGINT', 'UBIGINT', 'DOUBLE')")
_in = lambda x, values: f"{x} IN ({', '.join(f"'{v}'" for v in values)})"
_either = lambda k, rule: f"({_t(k)} IS NULL OR coalesce({rule}, false))"
_rules = [
    _either("banks", f"{_t('banks')} = 'ARRAY' AND len(list_filter(TRY_CAST(json_extract(j, '$.arguments.banks') AS JSON[]), lambda b: json_type(b) <> 'VARCHAR' OR NOT {_in('CAST(b ->> \'$\' AS VARCHAR)', BANKS)})) = 0"),
    *(_either(k, f"{_t(k)} = 'VARCHAR' AND {_in(_s(k), allowed)}") for k, allowed in p.ENUMS.items()),
    _either("term_months", f"{_whole('term_months')} AND TRY_CAST({_s('term_months')} AS DOUBLE) > 0"),
    _either("amount", f"{_number('amount')} AND TRY_CAST({_s('amount')} AS DOUBLE) >= 0"),
    _either("fee_priority", f"{_t('fee_priority')} = 'BOOLEAN'"),
]
_absent = lambda k: f"({_t(k)} IS NULL OR {_t(k)} = 'NULL')"
_n = lambda k: f"CASE WHEN {_number(k)} THEN TRY_CAST({_s(k)} AS DOUBLE) END"
_range = f"(({_absent('term_months_min')} AND {_absent('term_months_max')}) OR ({_whole('term_months_min')} AND {_whole('term_months_max')} AND {_n('term_months_min')} >= 1 AND {_n('term_months_min')} <= {_n('term_months_max')} AND {_n('term_months_max')} <= 240 AND {_n('term_months_max')} - {_n('term_months_min')} <= 23 AND {_n('term_months')} = {_n('term_months_max')}))"
_quote = f"({' AND '.join(f'{_t(k)} IS NOT NULL' for k in p.QUOTE_NEEDS)} AND {_in(_s('financing_type'), p.QUOTED)} AND {_whole('term_months')} AND {_n('term_months')} BETWEEN 1 AND 240 AND {_number('amount')} AND {_n('amount')} > 0 AND {_n('amount')} <= 100000000 AND {_range})"
_tools = " ".join(f"WHEN '{i}' THEN {tools}" for i, tools in p.INTENT_TOOLS.items() if tools)
_known = " ".join(f"WHEN '{t}' THEN {names}" for t, names in p.TOOL_ARGUMENTS.items())
VALID = f"""coalesce(j IS NOT NULL AND list_sort(json_keys(j)) = ['arguments', 'name'] AND list_contains(CASE intent {_tools} ELSE []::VARCHAR[] END, json_extract_string(j, '$.name'))
    AND len(list_filter(json_keys(j, '$.arguments'), lambda k: NOT list_contains(CASE json_extract_string(j, '$.name') {_known} ELSE []::VARCHAR[] END, k))) = 0 AND {" AND ".join(_rules)} AND (json_extract_string(j, '$.name') <> 'financing_quote' OR coalesce({_quote}, false)), false)"""
CALLS_SQL = f"WITH c AS (SELECT *, CASE WHEN json_valid(call) THEN call::JSON END AS j, CASE WHEN json_valid(other) THEN other::JSON END AS o FROM ({CALLS})), v AS (SELECT *, {VALID} AS valid FROM c)"


@query("q07_tool_calls", f"{CALLS_SQL} SELECT event_id, valid FROM v")
def q07(spark, d):
    """Calls of an intent's tools with known arguments of the right kinds and bounds."""
    return calls(spark, d).select("event_id", p.valid_call(F.col("intent"), F.col("call"), BANKS).alias("valid"))


_keys = ["banks", "product_type", "financing_type", "metric", "aggregation", "term_months", "term_months_min", "term_months_max", "amount", "fee_priority", "extra"]
_equal = " AND ".join(f"json_extract(j, '$.arguments.{k}')::VARCHAR IS NOT DISTINCT FROM json_extract(o, '$.arguments.{k}')::VARCHAR" for k in _keys)


@query("q09_exact_authorisation", f"{CALLS_SQL} SELECT event_id, coalesce(valid AND j IS NOT NULL AND o IS NOT NULL AND {_equal}, false) AS runs FROM v")
def q09(spark, d):
    """A call runs only if it is the one that was validated, argument by argument, in whatever order."""
    own = calls(spark, d)
    return own.select("event_id", (p.valid_call(F.col("intent"), F.col("call"), BANKS) & p.authorised(F.col("call"), F.col("other"))).alias("runs"))


_action, _in_domain = _case("event_id * 3", ["ANSWER", "CLARIFY", "REFUSE", "ANSWER", "REDIRECT"]), "event_id % 11 <> 0"
_term, _fee = "CASE WHEN user_id % 3 <> 0 THEN 12 END", "CASE WHEN user_id % 4 <> 0 THEN true END"
_no_calls = "event_id % 5 = 0"


@query("q08_policy_precedence", f"""{CALLS_SQL}, x AS (SELECT *, {_action} AS proposed, json_extract_string(j, '$.name') AS tool FROM v),
y AS (SELECT *, intent = 'product_comparison' AND (user_id % 3 = 0 OR user_id % 4 = 0) AND (proposed = 'CLARIFY' OR {_no_calls} OR (NOT {_no_calls} AND coalesce(tool = 'financing_quote' OR (tool = 'comparison' AND (coalesce({_s('product_type')} = 'financing', false) OR {_s('financing_type')} IS NOT NULL)), false))) AS ask FROM x)
SELECT event_id, CASE WHEN NOT ({_in_domain}) THEN 'REFUSE' WHEN NOT ({_no_calls}) AND NOT valid THEN 'REFUSE' WHEN proposed IN ('REFUSE', 'REDIRECT') THEN proposed WHEN ask THEN 'CLARIFY' ELSE proposed END AS action,
    CASE WHEN NOT ({_in_domain}) THEN 'out_of_domain' WHEN NOT ({_no_calls}) AND NOT valid THEN 'invalid_tool_plan' WHEN proposed IN ('REFUSE', 'REDIRECT') THEN NULL WHEN ask THEN 'missing_comparison_criteria' END AS reason FROM y""")
def q08(spark, d):
    """What becomes of proposed decisions with their calls and criteria."""
    own = calls(spark, d).withColumns({"proposed": F.expr(_action), "inside": F.expr(_in_domain), "calls": F.when(F.expr(_no_calls), F.array().cast("array<string>")).otherwise(F.array("call"))})
    criteria = F.struct(F.expr(_term).alias("term_months"), F.lit(1.0).alias("amount"), F.expr(_fee).alias("fee_priority"))
    out = own.select("event_id", p.decide(F.col("inside"), F.col("proposed"), F.col("intent"), F.col("calls"), criteria, BANKS).alias("r"))
    return out.select("event_id", "r.action", "r.reason")


AMOUNTS = ["{n} bin TL", "{n}.500 TL", "1,5 milyon TL", "tutar yok", "", "2{n} try ile", "0 TL"]
LENGTHS = ["{m} ay", "{d}-{m} ay", "{m} aylık vade", "5 yıl", "", "3 - {d} aylık", "1200 ay", "1300 ay"]
FEES = ["masrafsız olsun", "masraf önemli değil", "düşük masraf istemiyorum", "az masraf", "MASRAF ÖNCELİKLİ", "", "", "masraf önceliğim yok, masrafsız"]
TOLD = f"concat({_group('o_orderkey * 7 + o_custkey', AMOUNTS)}, ' ', {_group('o_orderkey + o_custkey * 3', LENGTHS)}, '; ', {_group('o_orderkey * 5 + o_custkey', FEES)})"
ASKED = f"SELECT o_orderkey AS id, o_custkey AS other, {TOLD} AS text FROM {{orders}}"


def _criteria_sql(text: str) -> dict[str, str]:
    """Each criterion of a text, as SQL."""
    of = lambda pattern, g: f"nullif(regexp_extract({text}, '(?i){_around(pattern)}', {g}), '')"
    a, b = f"{of(p.RANGE, 1)}::INT", f"{of(p.RANGE, 2)}::INT"
    ranged = f"coalesce(least({a}, {b}) >= 1 AND greatest({a}, {b}) <= 240 AND greatest({a}, {b}) - least({a}, {b}) <= 23, false)"
    alone, raw = f"{of(p.TERM, 1)}::INT", of(p.MONEY, 1)
    factor = f"CASE lower({of(p.MONEY, 2)}) WHEN 'bin' THEN 1000 WHEN 'milyon' THEN 1000000 ELSE 1 END"
    decimal = f"CASE WHEN regexp_matches({raw}, '[.,][0-9]{{1,2}}$') THEN replace({raw}, ',', '.')::DOUBLE ELSE translate({raw}, '.,', '')::DOUBLE END"
    amount = f"({decimal} * {factor})"
    fees = f"list_filter(list_transform(string_split_regex({_low(text)}, '[;,.!?]+'), lambda c: CASE WHEN regexp_matches(c, '{p.NO_FEE}') THEN 0 WHEN regexp_matches(c, '{p.FEE}') THEN 1 END), lambda x: x IS NOT NULL)[1]"
    return {
        "term_months": f"CASE WHEN {ranged} THEN greatest({a}, {b}) WHEN {alone} BETWEEN 1 AND 1200 THEN {alone} END",
        "term_months_min": f"CASE WHEN {ranged} THEN least({a}, {b}) END",
        "term_months_max": f"CASE WHEN {ranged} THEN greatest({a}, {b}) END",
        "amount": f"CASE WHEN {amount} > 0 AND {amount} <= 1000000000 THEN {amount} END",
        "fee_priority": f"({fees} = 1)",
    }


def asked(spark, d) -> DataFrame:
    return spark.sql(ASKED, orders=frame(spark, d, "orders"))


_told = ", ".join(f"{sql} AS {k}" for k, sql in _criteria_sql("text").items())


@query("q16_criteria", f"SELECT id, {_told} FROM ({ASKED.replace('{orders}', 'orders')})")
def q16(spark, d):
    """The criteria that a question names: terms and their ranges, sums, whether fees matter."""
    return asked(spark, d).select("id", p.criteria(F.col("text")).alias("c")).select("id", "c.*")


@query("q10_plan_merge", f"WITH t AS (SELECT id, other, {_told} FROM ({ASKED.replace('{orders}', 'orders')})) SELECT id, coalesce(term_months, CASE WHEN other % 3 = 0 THEN (1 + other % 36)::INT END) AS term_months, coalesce(amount, CASE WHEN other % 2 = 0 THEN (other * 10.0)::DOUBLE END) AS amount, coalesce(fee_priority, other % 5 = 0) AS fee_priority FROM t")
def q10(spark, d):
    """A question's own criteria, filled up from a proposal and never overridden by it."""
    own = asked(spark, d).select("id", "other", p.criteria(F.col("text")).alias("c"))
    proposed = F.struct(F.when(F.col("other") % 3 == 0, (1 + F.col("other") % 36).cast("int")).alias("term_months"), F.when(F.col("other") % 2 == 0, (F.col("other") * 10.0).cast("double")).alias("amount"), (F.col("other") % 5 == 0).alias("fee_priority"))
    whole = own.select("id", p.merged(F.col("c"), proposed, ["term_months", "amount", "fee_priority"]).alias("m"))
    return whole.select("id", "m.term_months", "m.amount", "m.fee_priority")


#: What the users of conversations say: criteria, bare answers, and other things.
SAID = ["250 bin TL", "24 ay", "12", "evet", "Hayır.", "36-24 ay ve 90.000 TL", "masrafsız olsun", "yok", "merhaba", "500", "fark etmez", "teşekkürler", "1,5 milyon TL; masraf önemli değil", "6!"]
TURNS = f"SELECT conv_id, turn, role, {_group('conv_id * 7 + turn * 5', SAID)} AS text FROM {{conversations}}"
CRITERIA = ["term_months", "amount", "fee_priority"]


def turns(spark, d) -> DataFrame:
    return spark.sql(TURNS, conversations=frame(spark, d, "conversations"))


def conversation_criteria(rows: DataFrame) -> DataFrame:
    """Turns (conv_id, turn, role, text) with the criteria known after each, and which is asked for next.

    A user's turn may name criteria; a bare number or a bare yes or no answers what is asked for before it, the first
    criterion that isn't known.  What is known is one of eight states, so a conversation of any length is a scan.
    """
    c = p.criteria(F.col("text"))
    says = rows.select("conv_id", "turn", "role", "text", *(F.when(F.col("role") == "user", c[k]).alias(f"named_{k}") for k in CRITERIA), F.when(F.col("role") == "user", p.bare_months(F.col("text"))).alias("months"), F.when(F.col("role") == "user", p.bare_choice(F.col("text"))).alias("choice"))
    named = sum((F.when(F.col(f"named_{k}").isNotNull(), 1 << i).otherwise(0) for i, k in enumerate(CRITERIA)), F.lit(0))

    def after(state: int):
        asks = next((i for i in range(3) if not state & 1 << i), None)
        answered = F.when(F.col("months").isNotNull(), 1).otherwise(0) if asks == 0 else F.when(F.col("choice").isNotNull(), 4).otherwise(0) if asks == 2 else F.lit(0)
        return F.lit(state).bitwiseOR(named).bitwiseOR(answered).cast("int")

    blocks = scan.in_blocks(says.withColumn("step", F.array(*(after(s) for s in range(8)))), ["conv_id"], ["turn", "role", "text"])
    seen = scan.states(blocks, ["conv_id"], "step", 8)
    before = F.col("before")
    own = {
        "term_months": F.coalesce("named_term_months", F.when(before.bitwiseAND(1) == 0, F.col("months"))),
        "amount": F.col("named_amount"),
        "fee_priority": F.coalesce("named_fee_priority", F.when(before.bitwiseAND(7) == 3, F.col("choice"))),
    }
    known = scan.carried(seen.select("conv_id", "turn", "role", "_place", "_block", "after", *(v.alias(k) for k, v in own.items())), ["conv_id"], CRITERIA)
    state = F.col("after")
    asks = F.when(state.bitwiseAND(1) == 0, CRITERIA[0]).when(state.bitwiseAND(2) == 0, CRITERIA[1]).when(state.bitwiseAND(4) == 0, CRITERIA[2])
    return known.select("conv_id", "turn", "role", *CRITERIA, asks.alias("asks"))


_k = _criteria_sql("text")
TURNS_SQL = f"""WITH RECURSIVE t AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS k FROM ({TURNS.replace("{conversations}", "conversations")})),
n AS MATERIALIZED (SELECT conv_id, turn, role, k, CASE WHEN role = 'user' THEN {_k["term_months"]} END AS a, CASE WHEN role = 'user' THEN {_k["amount"]} END AS b, CASE WHEN role = 'user' THEN {_k["fee_priority"]} END AS c,
    CASE WHEN role = 'user' AND nullif(regexp_extract(text, '{p.BARE_MONTHS}', 1), '')::INT BETWEEN 1 AND 240 THEN regexp_extract(text, '{p.BARE_MONTHS}', 1)::INT END AS months,
    CASE WHEN role = 'user' THEN CASE WHEN regexp_matches({_low("text")}, '{p.NO}') THEN false WHEN regexp_matches({_low("text")}, '{p.YES}') THEN true END END AS choice FROM t),
w AS (SELECT conv_id, 0::BIGINT AS k, NULL::BIGINT AS turn, NULL::VARCHAR AS role, NULL::INT AS term_months, NULL::DOUBLE AS amount, NULL::BOOLEAN AS fee_priority FROM (SELECT DISTINCT conv_id FROM n)
    UNION ALL SELECT n.conv_id, n.k, n.turn, n.role, coalesce(n.a, CASE WHEN w.term_months IS NULL THEN n.months END, w.term_months), coalesce(n.b, w.amount),
        coalesce(n.c, CASE WHEN w.term_months IS NOT NULL AND w.amount IS NOT NULL AND w.fee_priority IS NULL THEN n.choice END, w.fee_priority) FROM w JOIN n ON n.conv_id = w.conv_id AND n.k = w.k + 1),
known AS (SELECT *, CASE WHEN term_months IS NULL THEN 'term_months' WHEN amount IS NULL THEN 'amount' WHEN fee_priority IS NULL THEN 'fee_priority' END AS asks FROM w WHERE k > 0)"""


@query("q17_clarified_turns", f"{TURNS_SQL} SELECT conv_id, turn, role, term_months, amount, fee_priority, asks FROM known")
def q17(spark, d):
    """What each turn of a conversation leaves known, and what is asked for next."""
    return conversation_criteria(turns(spark, d))


@query("st07_conversation_criteria", f"{TURNS_SQL} SELECT conv_id, turn, CASE WHEN asks IS NULL THEN 'ANSWER' ELSE 'CLARIFY' END AS action, asks FROM known WHERE role = 'user'")
def st07(spark, d):
    """What happens after each user's turn: the criteria that are carried along suffice, or one is asked for."""
    own = conversation_criteria(turns(spark, d)).where("role = 'user'")
    return own.select("conv_id", "turn", F.when(F.col("asks").isNull(), "ANSWER").otherwise("CLARIFY").alias("action"), "asks")


#: Answers of list items that cite the campaign or another: true, of another sum, uncited, and without claims.
_ANSWER = "concat('Özet 7', chr(10), '- İlk [1]: ', substr(text, 1, 40), chr(10), '- Oran %77 [1]', chr(10), '- Oran %77', chr(10), '- Bilgi yok', chr(10), '- Her şey ücretsiz [1][2]', chr(10), '- Tutar ', CAST(10 + id % 89 AS VARCHAR(4)), '00 TL [2]', chr(10), '2. madde [9]')"
_claimed = "list_distinct(list_filter(flatten([{0}]), lambda s: s IS NOT NULL))"
_num = lambda x: f"(CASE WHEN regexp_matches({x}, '[.][0-9.]*,|,[0-9,]*[.]') OR regexp_matches({x}, '[.,][0-9]{{1,2}}$') THEN regexp_replace(translate({x}, ',', '.'), '[.]([0-9.]*[.])', '\\1', 'g') ELSE translate({x}, '.,', '') END)::DOUBLE"


def _claims_sql(text: str) -> str:
    """The signatures of a text of plain numbers."""
    bare = f"regexp_replace(regexp_replace({text}, '{p.CITATION}', '', 'g'), '(?m)^\\s*[0-9]{{1,3}}[.)]\\s+', '', 'g')"
    digits = lambda x: f"regexp_extract({x}, '[0-9][0-9.,]*')"
    money, length = _around(p.MONEY_CLAIM).replace("'", "''"), _around(p.DURATION_CLAIM)
    rate = f"list_transform(regexp_extract_all({bare}, '{p.RATE_CLAIM}'), lambda x: concat('rate:', CAST({_num(digits('x'))} AS VARCHAR)))"
    sums = f"list_transform(regexp_extract_all({bare}, '(?i){money}'), lambda x: concat('money:', CAST({_num(digits('x'))} * CASE WHEN contains(lower(x), 'milyon') THEN 1000000 ELSE 1 END AS VARCHAR), ':TRY'))"
    spans = f"list_transform(regexp_extract_all({bare}, '(?i){length}'), lambda x: concat('duration:', regexp_extract(x, '[0-9]+'), ':', CASE WHEN regexp_matches(lower(x), 'g[üu]n') THEN 'day' WHEN contains(lower(x), 'ay') THEN 'month' ELSE 'year' END))"
    others = f"regexp_replace({bare}, '(?i){p.RATE_CLAIM}|{money}|{length}', ' ', 'g')"
    number = f"list_transform(regexp_extract_all({others}, '(?:^|[^\\p{{L}}\\p{{N}}_])([0-9][0-9.,]*)', 1), lambda x: concat('number:', CAST({_num('x')} AS VARCHAR)))"
    free = f"CASE WHEN regexp_matches({bare}, '(?i){p.FREE_CLAIM}') THEN ['fee:free'] ELSE [] END"
    return _claimed.format(", ".join((rate, sums, spans, number, free)))


@query("q14_claims_in_evidence", f"""WITH t AS (SELECT a.id, a.text, {_ANSWER.replace("text", "a.text").replace("id %", "a.id %")} AS answer, coalesce(b.text, '') AS second FROM ({CAMPAIGNS}) a LEFT JOIN ({CAMPAIGNS}) b ON b.id = a.id + 1),
l AS (SELECT id, text, second, unnest(range(1, len(string_split(answer, chr(10))) + 1)) AS k, unnest(string_split(answer, chr(10))) AS line FROM t), s AS MATERIALIZED (SELECT id, {_claims_sql("text")} AS one, {_claims_sql("second")} AS two FROM t),
c AS (SELECT l.id, k, line, {_claims_sql("line")} AS own, list_distinct(list_transform(regexp_extract_all(line, '{p.CITATION}', 1), lambda x: x::INT)) AS cited, one, two FROM l JOIN s USING (id)),
v AS (SELECT id, k, line, NOT regexp_matches(line, '^- ') OR len(own) = 0 OR (len(cited) > 0 AND len(list_filter(own, lambda x: NOT ((list_contains(cited, 1) AND list_contains(one, x)) OR (list_contains(cited, 2) AND list_contains(two, x))))) = 0) AS holds FROM c)
SELECT id, string_agg(line, chr(10) ORDER BY k) FILTER (holds) AS text, count(*) FILTER (NOT holds)::INT AS dropped FROM v GROUP BY id""")
def q14(spark, d):
    """Answers without the items whose claims the campaigns that they cite don't hold; the second source is the next campaign."""
    own = campaigns(spark, d).withColumn("claims", p.claims(F.col("text")))
    second = own.select((F.col("id") - 1).alias("id"), F.col("claims").alias("second"))
    both = own.join(second, "id", "left").select("id", F.expr(_ANSWER).alias("answer"), F.array("claims", F.coalesce("second", F.array().cast("array<string>"))).alias("s"))
    return both.select("id", p.supported(F.col("answer"), F.col("s")).alias("a")).select("id", "a.text", "a.dropped")


TOPICS = ["Bitcoin almak", "Mevduat faizi", "Konut finansmanı", "Kripto para", "FOREX hesabı", "Katılma hesabı", "Hisse senedi", "Kaldıraçlı işlem", "kriptografi dersi", "Faiz getirisi", "katılım esasları", "Hisse", "akripto"]
TOPIC_TEXTS = f"SELECT o_orderkey AS id, concat({_group('o_orderkey * 7 + o_custkey', TOPICS)}, {_group('o_custkey * 5 + o_orderkey', LINKS)}, {_group('o_orderkey * 3 + o_custkey * 11', ACTIONS)}) AS text FROM {{orders}}"


@query("f18_out_of_domain", f"SELECT id, regexp_matches(lower(translate(text, 'Iİ', 'ıi')), '(?:^|[^\\p{{L}}\\p{{N}}_])(?:{intents.OUTSIDE})') AS outside FROM ({TOPIC_TEXTS.replace('{orders}', 'orders')})")
def f18(spark, d):
    """Questions about conventional finance."""
    own = spark.sql(TOPIC_TEXTS, orders=frame(spark, d, "orders"))
    return own.select("id", intents.says(intents.small(F.col("text")), intents.STEM, intents.OUTSIDE).alias("outside"))

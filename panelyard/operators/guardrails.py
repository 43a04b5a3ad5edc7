"""Nine ordered guardrails over decision cards.

A card is a state (grade, action, weight, suggestion, target) and the list of rules that fired; each
rule sees the state that those before it left. The chain is a fold over the rules' numbers, so a
rule's expression stands in the plan once, whatever the number of rules before it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: grades and actions of cards
DIG, WATCH, ASIDE, UNKNOWN = "继续深挖", "放入观察", "暂时剔除", "信息不足"
RAISE, HOLD, LOWER, NO_ACTION, TO_CASH = "增加研究暴露", "保持观察", "降低研究暴露", "信息不足不动作", "转入现金"
# fixed values: the rules' names in their order
RULES = (
    "financial_risk_to_zero_guard_v1", "financial_report_only_no_upgrade_without_confirmation_v1", "capped_news_positive_with_unresolved_confirmation_gap", "portfolio_cross_channel_confirmation_gap_v1",
    "rag_applicable_failure_no_upgrade_v1", "single_stock_risk_review_queue_no_raise_v1", "small_entry_softgap_floor_v1", "action_label_buy_add_softgap_floor_v1", "action_label_wait_reduce_cap_v1",
)
HARD_GAPS = ("peer_gap_or_weak", "overheat_or_high_volatility", "quant_tool_gap")
DEFAULT_VARIANTS = (
    "deepseek_agent", "full_agent", "full_agent_with_quant_tools", "full_agent_without_quant_tools", "keyword_plus_questionnaire", "keyword_plus_questionnaire_guarded",
    "news_plus_financial_report", "news_plus_financial_report_guarded", "kline_weak_prompt",
)

_STATE = ("grade", "action", "weight", "suggestion", "target")


def guarded(cards: DataFrame) -> DataFrame:
    """cards with grade, action, weight, suggestion and target after all rules, and fired.

    Beside the state, a card holds what the rules ask: financial_guard, variant, positive_capped,
    confirmation_gap, task_mode, gaps (array), strong_quant, failure_cases, review_queue,
    no_downweight, operation, from_label_scorer, hard_counter, floor and plan_target."""
    c = F.col
    yes = lambda name: F.coalesce(c(name), F.lit(False))

    def up(s: Column) -> Column:
        return (s["grade"] == DIG) | (s["action"] == RAISE)

    def put(s: Column, rule: int, **new: Column) -> Column:
        fields = [F.coalesce(new.get(k, s[k]), s[k]).alias(k) for k in _STATE]
        return F.struct(*fields, F.concat(s["fired"], F.array(F.lit(RULES[rule]))).alias("fired"))

    def when(test: Column, value: Column, s: Column) -> Column:
        return F.when(F.coalesce(test, F.lit(False)), value).otherwise(s)

    def lowered(s: Column) -> Column:
        return F.when(s["grade"] == DIG, WATCH).otherwise(s["grade"])

    def held(s: Column, weight: Column) -> dict[str, Column]:
        """Down from digging and raising, to watching at a small weight."""
        rising = s["action"] == RAISE
        return {"grade": lowered(s), "action": F.when(rising, HOLD).otherwise(s["action"]), "weight": F.when(rising, weight).otherwise(s["weight"])}

    def least(x: Column, most: float) -> Column:
        return F.when(x.isNull(), most).otherwise(F.least(x, F.lit(most)))

    def financial(s: Column) -> Column:
        test = yes("financial_guard") & (s["action"].isin(RAISE, HOLD, LOWER) | (s["grade"] == DIG))
        return when(test, put(s, 0, grade=lowered(s), action=F.lit(NO_ACTION), weight=F.lit(0.0)), s)

    def report_only(s: Column) -> Column:
        return when((c("variant") == "financial_report_only") & up(s), put(s, 1, **held(s, least(s["weight"], 0.1))), s)

    def news_capped(s: Column) -> Column:
        return when(yes("positive_capped") & yes("confirmation_gap") & up(s), put(s, 2, **held(s, F.lit(0.1))), s)

    def portfolio(s: Column) -> Column:
        soft = yes("strong_quant") & ~F.arrays_overlap("gaps", F.array(*map(F.lit, HARD_GAPS)))
        test = c("task_mode").isin("portfolio_pool", "portfolio_pool_optimize") & F.coalesce("variant", F.lit("deepseek_agent")).isin(*DEFAULT_VARIANTS) & (F.size("gaps") >= 3) & ~soft
        return when(test & up(s), put(s, 3, **held(s, F.lit(0.1))), s)

    def failures(s: Column) -> Column:
        return when(yes("failure_cases") & up(s), put(s, 4, **held(s, least(s["weight"], 0.1))), s)

    def review(s: Column) -> Column:
        spare = yes("no_downweight")
        most = F.when(spare, 0.1).otherwise(0.05)
        w, a = s["weight"], s["action"]
        grade = lowered(s)
        capped = F.coalesce(F.least(w, most), most)
        kept = F.when(spare & (grade == WATCH), F.when(w.isNull() | (w < most), most).otherwise(F.least(w, most))).otherwise(capped)
        weight = F.when(a == RAISE, most).when(a.isin(HOLD, LOWER), kept).otherwise(w)
        action = (
            F.when(a == RAISE, F.when(spare, HOLD).otherwise(LOWER))
            .when(spare & (grade == WATCH) & (a == LOWER), HOLD)
            .when(~spare & (a == HOLD) & (w > most), LOWER)
            .otherwise(a)
        )
        changed = (s["grade"] == DIG) | (action != a) | ~weight.eqNullSafe(w)
        return when(c("task_mode").isin("single_stock", "single_stock_watch") & yes("review_queue") & changed, put(s, 5, grade=grade, action=action, weight=weight), s)

    def raised(s: Column, rule: int, test: Column, floor: Column, said: str) -> Column:
        watched = F.when(s["grade"].isin(DIG, WATCH), s["grade"]).otherwise(WATCH)
        weight = F.greatest(F.coalesce(s["weight"], F.lit(0.0)), F.least(floor, F.lit(0.2)))
        open_ = test & ~yes("hard_counter") & (F.coalesce(s["target"], F.lit(0.0)) < floor)
        return when(open_, put(s, rule, grade=watched, action=F.lit(HOLD), weight=weight, suggestion=F.lit(said), target=floor), s)

    def small_entry(s: Column) -> Column:
        floor = F.greatest(F.lit(0.1), F.least(F.lit(0.35), F.coalesce("plan_target", "floor", F.lit(0.1))))
        return raised(s, 6, c("operation") == "small_buy_hold", floor, "试探买入/持有")

    def buy_add(s: Column) -> Column:
        low = F.coalesce("floor", F.lit(0.10))
        floor = F.greatest(F.lit(0.10), F.least(low, F.coalesce(c("plan_target"), low), F.lit(0.25)))
        return raised(s, 7, (c("operation") == "buy_add") & yes("from_label_scorer"), floor, "试探买入/持有复核")

    def wait(s: Column) -> Column:
        waits = c("operation") == "wait"
        target, weight = F.when(waits, 0.0).otherwise(0.10), F.when(waits, 0.0).otherwise(0.05)
        over = ~((F.coalesce(s["target"], F.lit(0.0)) <= target) & F.coalesce(s["weight"] <= weight, F.lit(False)))
        grade = F.when(waits, F.when(s["grade"].isin(UNKNOWN, ASIDE), s["grade"]).otherwise(ASIDE)).otherwise(F.when(s["grade"].isin(UNKNOWN, WATCH, ASIDE), s["grade"]).otherwise(WATCH))
        new = put(s, 8, grade=grade, action=F.when(waits, TO_CASH).otherwise(LOWER), weight=F.coalesce(F.least(s["weight"], weight), weight), suggestion=F.when(waits, "等待不买").otherwise("减仓/卖出复核"), target=F.least(F.coalesce(s["target"], F.lit(0.0)), target))
        return when(yes("from_label_scorer") & c("operation").isin("wait", "reduce_review") & over, new, s)

    chain = (financial, report_only, news_capped, portfolio, failures, review, small_entry, buy_add, wait)
    start = F.struct(*(c(k).cast("double" if k in ("weight", "target") else "string").alias(k) for k in _STATE), F.array().cast("array<string>").alias("fired"))

    def step(s: Column, i: Column) -> Column:
        out = F
        for k, rule in enumerate(chain):
            out = out.when(i == k, rule(s))
        return out.otherwise(s)

    out = cards.withColumn("_end", F.aggregate(F.sequence(F.lit(0), F.lit(len(chain) - 1)), start, step))
    return out.withColumns({**{k: F.col(f"_end.{k}") for k in _STATE}, "fired": F.col("_end.fired")}).drop("_end")

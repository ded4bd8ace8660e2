"""Research tables derived by Spark from the given input tables.

The given data has no stock tables, so instruments come from suppliers, bars
from line items, runs and forecasts from orders, plans and ticks from events,
chat from conversations and news from documents.  FIXTURES.md states each
mapping.  Nothing here ranks inside an unbounded group: everything is an
aggregate that combines before its shuffle, or a window bounded by the calendar.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickerloom.functions.scalar import token_cost
from tickerloom.functions.text import cache_key
from tickerloom.operators.newest import newest_row
from tickerloom.plans.company import RISK_RULES
from tickerloom.session import pin, scratch_path
from tickerloom.sources.snapshots import document_lines, write_snapshot_files
from tickerloom.sources.tables import input_stream, input_table, risk_rules, risk_rules_file

MODEL, SYSTEM_PROMPT = "assistant-v1", "research"
CHART_ROOT = "/srv/research"


def code_of(number: str) -> Column:
    """At least six digits; longer numbers are kept whole."""
    text = F.col(number).cast("string")
    return F.lpad(text, F.greatest(F.length(text), F.lit(6)), F.lit("0"))


def market_of(number: str) -> Column:
    return F.when(F.col(number) % 10 == 9, "hk").otherwise("a")


def seconds(number: Column) -> Column:
    return F.make_dt_interval(secs=number.cast("decimal(18,6)"))


def text(*parts) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


class Research:
    """Lazily derived research tables over one input folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def given(self, name: str) -> DataFrame:
        return input_table(self.spark, self.folder, name)

    @cached_property
    def instruments(self) -> DataFrame:
        s, n = self.given("supplier"), self.given("nation")
        listed = F.date_add(F.lit("1990-01-01").cast("date"), (F.col("s_suppkey") % 1000).cast("int"))
        return s.join(n, s.s_nationkey == n.n_nationkey).select(
            code_of("s_suppkey").alias("ts_code"),
            text("Co", F.col("s_suppkey").cast("string")).alias("name"),
            F.col("n_name").alias("industry"),
            market_of("s_suppkey").alias("market"),
            F.when(F.col("s_suppkey") % 7 != 0, listed).alias("listing_date"),
        )

    @cached_property
    def concept_members(self) -> DataFrame:
        """Brands that make up more than their even share of a supplier's traded quantity."""
        pairs = self._brands(F.sum("l_quantity"))
        return pairs.select(
            code_of("l_suppkey").alias("ts_code"),
            text("Co", F.col("l_suppkey").cast("string")).alias("name"),
            market_of("l_suppkey").alias("market"),
            F.when(F.col("p_brand") != "Brand#25", F.col("p_brand")).alias("concept_name"),
        )

    def _brands(self, measure: Column) -> DataFrame:
        """(l_suppkey, p_brand) of the brands above the mean of the supplier's brands; a supplier has no more of these than there are brands."""
        # Lines are counted up by part before its brand is looked up.
        l = self.given("lineitem").groupBy("l_suppkey", "l_partkey").agg(measure.alias("_n")).join(self.given("part"), F.col("l_partkey") == F.col("p_partkey"))
        own = Window.partitionBy("l_suppkey")
        sums = l.groupBy("l_suppkey", "p_brand").agg(F.sum("_n").alias("_m"))
        above = F.col("_m") * F.count("*").over(own) > F.sum("_m").over(own)
        return sums.withColumn("_above", above).filter("_above").select("l_suppkey", "p_brand")

    @cached_property
    def _day_bars(self) -> DataFrame:
        price = F.col("l_extendedprice") / F.col("l_quantity")
        tick = F.struct("l_orderkey", "l_linenumber", "l_partkey")
        return (
            self.given("lineitem")
            .groupBy("l_suppkey", F.to_date("l_shipdate").alias("trade_date"))
            .agg(
                F.min_by(price, tick).alias("open"),
                F.max(price).alias("high"),
                F.min(price).alias("low"),
                F.max_by(price, tick).alias("close"),
                F.sum("l_quantity").alias("volume"),
                F.sum("l_extendedprice").alias("amount"),
            )
        )

    @cached_property
    def daily_prices(self) -> DataFrame:
        """One bar per instrument and day, so a per-instrument window is bounded by the calendar.

        Ticks are combined by instrument and day before they move, so a heavily
        traded instrument is no hot spot; the bars then move once, by (market,
        ts_code), and every later window reuses that partitioning.
        """
        before = F.lag("close").over(Window.partitionBy("market", "ts_code").orderBy("trade_date"))
        bars = self._day_bars.withColumns({"ts_code": code_of("l_suppkey"), "market": market_of("l_suppkey")})
        return bars.select(
            "ts_code", "market", "trade_date", "open", "high", "low", "close", "volume", "amount",
            ((F.col("close") / before - 1.0) * 100.0).alias("pct_chg"),
            (F.col("volume") / 1e4 * 1e2).alias("turnover_rate"),
        )

    @cached_property
    def pick_runs(self) -> DataFrame:
        o = self.given("orders")
        kind = F.when(F.col("o_orderstatus") == "F", "scan").when(F.col("o_orderstatus") == "O", "llm_top300").otherwise("report")
        return o.select(
            F.col("o_orderkey").alias("id"),
            kind.alias("run_kind"),
            F.to_date("o_orderdate").alias("trade_date_as_of"),
            text("v", F.col("o_orderpriority")).alias("rule_version"),
            (F.col("o_orderstatus") == "O").alias("llm_enabled"),
            F.when(F.col("o_orderstatus") == "O", "model-a").alias("llm_model"),
            F.when(F.col("o_orderkey") % 9 == 0, F.lit(""))
            .when(F.col("o_orderkey") % 11 == 0, F.lit("{bad"))
            .otherwise(text('{"customer":', F.col("o_custkey").cast("string"), "}"))
            .alias("summary_json"),
            (F.col("o_orderdate") + seconds(F.col("o_orderkey") % 86400)).alias("created_at_utc"),
        )

    @cached_property
    def pick_entries(self) -> DataFrame:
        quantity, discount = F.col("l_quantity"), F.col("l_discount")
        price = F.col("l_extendedprice") / quantity
        rule = quantity * 2.0
        llm = rule + (discount - 0.05) * 200.0
        plain = F.col("l_returnflag") == "R"
        s = lambda c: F.col(c).cast("string")
        return self.given("lineitem").select(
            F.concat_ws(
                "-", s("l_orderkey"), s("l_linenumber"), s("l_partkey"), s("l_suppkey"), F.date_format("l_shipdate", "yyyyMMdd")
            ).alias("id"),
            F.col("l_orderkey").alias("run_id"),
            code_of("l_suppkey").alias("ts_code"),
            text("Co", s("l_suppkey")).alias("name"),
            F.col("l_linenumber").cast("bigint").alias("rank_in_run"),
            price.alias("close_price"),
            rule.alias("rule_composite_score"),
            F.when(~plain, llm).alias("llm_composite_score"),
            F.when(plain, rule).otherwise(llm).alias("final_composite_score"),
            F.when(quantity >= 45, "强烈关注").when(quantity >= 30, "关注").when(quantity >= 15, "观望").otherwise("回避").alias("recommendation"),
            F.when(F.col("l_linestatus") == "O", "keep").otherwise("drop").alias("verdict"),
            (price * (1.0 - discount)).alias("predicted_buy_price"),
            (price * (1.0 + F.col("l_tax") + 0.05)).alias("predicted_target_price"),
            (price * 0.92).alias("predicted_stop_loss"),
            text('{"qty":', F.col("l_quantity").cast("bigint").cast("string"), "}").alias("report_json"),
            text("# Co", s("l_suppkey")).alias("markdown"),
            F.when(F.col("l_orderkey") % 6 == 0, F.lit(None).cast("string"))
            .otherwise(
                text(
                    '{"signals":["', F.when(quantity >= 25, "均线多头").otherwise("均线空头"), '","',
                    F.when(plain, "MACD死叉").otherwise("MACD金叉"), '"],"llm_brief":{"summary":"line ', s("l_linenumber"),
                    '"},"ret_20d":', F.col("l_quantity").cast("bigint").cast("string"), ',"kdj":{"k":', s("l_linenumber"), "}}",
                )
            )
            .alias("analysis_process_json"),
            F.when(F.col("l_orderkey") % 50 != 0, F.col("l_shipdate") + seconds(F.col("l_orderkey") % 86400)).alias("created_at_utc"),
        )

    @cached_property
    def pick_outcomes(self) -> DataFrame:
        l = self.given("lineitem").withColumn("h", F.explode(F.array(F.lit(1), F.lit(3), F.lit(5))))
        s = lambda c: F.col(c).cast("string")
        return l.select(
            F.concat_ws(
                "-", s("l_orderkey"), s("l_linenumber"), s("l_partkey"), s("l_suppkey"), F.date_format("l_shipdate", "yyyyMMdd")
            ).alias("entry_id"),
            F.col("h").alias("horizon_days"),
            F.round((F.col("l_discount") - F.col("l_tax")) * 100.0 * F.col("h"), 4).alias("return_pct"),
            (F.col("l_discount") <= 0.05).alias("hit_buy"),
            ((F.col("l_discount") - F.col("l_tax")) * F.col("h") > 0.1).alias("hit_target"),
            (F.col("l_tax") * F.col("h") > 0.2).alias("hit_stop"),
        ).filter(F.col("h") <= F.col("l_linenumber") + 1)

    @cached_property
    def market_forecasts(self) -> DataFrame:
        """The first order of each day stands for that day's forecast: at most one row per calendar day."""
        first = self.given("orders").groupBy(F.to_date("o_orderdate").alias("as_of_date")).agg(
            F.min("o_orderkey").alias("id"), F.min_by("o_orderstatus", "o_orderkey").alias("status")
        )
        n = F.col("id")
        pct = ((n * 7919) % 601 - 300) / F.lit(1e2)
        kind = F.when(F.col("status") == "F", "bullish").when(F.col("status") == "O", "bearish").otherwise("range-bound")
        actual = F.when(pct > 0.5, "bullish").when(pct < -0.5, "bearish").otherwise("range-bound")
        number = lambda c: c.cast("string")
        forecast = text(
            '{"market_direction":{"direction":"', kind, '","confidence":', number(n * 37 % 101),
            ',"reasoning":"day ', number(n), '","evidence":[{"type":"flow","signal":"north","value":"', number(n % 7),
            '"},{"type":"trend","signal":"ma","value":"', number(n % 5), '"}],"counter_evidence":["risk ', number(n % 3),
            '"]},"index_forecasts":[{"code":"000001","name":"上证指数","direction":"偏多","confidence":', number(n % 100),
            ',"key_levels":{"support":', number(n % 1000), ',"resistance":', number(n % 1000 + 50),
            '}},{"code":"399001","name":"深证成指","direction":"偏空","confidence":', number(n % 90), '}],"next_day_scenarios":[{"scenario":"up","probability":',
            number(n % 101), ',"trigger":"volume"},{"scenario":"down","probability":', number(100 - n % 101),
            ',"trigger":"break"}],"sector_calls":[{"sector":"S', number(n % 12),
            '","direction":"看多","confidence":', number(n % 80), ',"evidence":[{"signal":"a","value":"1"},{"signal":"b","value":"', number(n % 4),
            '"}]}],"concept_calls":[{"concept":"C', number(n % 9), '","direction":"看多","reasoning":"hot"}],"risk_factors":["r', number(n % 6), '","r9"]}',
        )
        charts = text(
            '{"000001":{"kline":"', CHART_ROOT, "/charts/d", number(n), '/k.png","macd":"/tmp/d', number(n),
            '.png"},"399001":"', CHART_ROOT, "/charts/d", number(n), '.png","sector_heatmap":"', CHART_ROOT, '/charts/heat.png"}',
        )
        noon = F.col("as_of_date").cast("timestamp_ntz")
        return first.select(
            "id", "as_of_date", kind.alias("market_direction"),
            F.when(n % 13 != 0, (n * 37 % 101).cast("double")).alias("direction_confidence"),
            F.when(n % 23 == 0, F.lit("{bad")).otherwise(forecast).alias("forecast_json"),
            F.when(n % 29 == 0, F.lit("")).otherwise(charts).alias("index_charts_json"),
            (n % 2 == 0).alias("push_sent"),
            F.when(n % 10 != 0, noon + F.expr("INTERVAL 42 HOURS")).alias("verified_at"),
            actual.alias("actual_direction"), pct.alias("actual_pct_chg"),
            F.when(n % 31 != 0, kind == actual).alias("direction_correct"),
            (noon + F.expr("INTERVAL 17 HOURS")).alias("created_at_utc"),
        )

    @cached_property
    def forecast_evals(self) -> DataFrame:
        n = F.col("id")
        flag = lambda k: F.when(n % k == 0, "true").otherwise("false")
        results = text('[{"code":"000001","correct":', flag(2), '},{"code":"399001","correct":', flag(3), '},{"correct":true}]')
        return self.market_forecasts.select(
            n.alias("forecast_id"),
            F.when(n % 4 == 0, 3).otherwise(1).alias("horizon_days"),
            F.when(n % 17 == 0, F.lit("{bad")).when(n % 19 != 0, results).alias("index_results_json"),
        )

    @cached_property
    def chat_messages(self) -> DataFrame:
        c = self.given("conversations")
        conv, user = F.col("conv_id"), F.col("role") == "user"
        number = F.col("conv_id").cast("string")
        padded = F.lpad(number, F.greatest(F.length(number), F.lit(6)), F.lit("0"))
        asks = user & (F.col("turn") % 3 == 0)
        content = (
            F.when(asks & (conv % 3 == 0), text("分析 ", padded, " ", F.col("text")))
            .when(asks & (conv % 3 == 1), text("看看 Co", number, " ", F.col("text")))
            .otherwise(F.col("text"))
        )
        size = F.length("text").cast("bigint")
        answer = F.when(~user & (F.col("role") == "assistant"), size * 2)
        start = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
        return c.select(
            (conv * 100 + F.col("turn")).alias("id"), conv.alias("session_id"), "role", content.alias("content"),
            F.when(F.col("role") == "assistant", "chat").alias("intent"),
            size.alias("prompt_tokens"), answer.alias("output_tokens"), token_cost(size, answer).alias("cost_usd"),
            F.when(F.col("role") == "assistant", size * 3).alias("elapsed_ms"),
            (start + seconds(conv * 1800 + F.col("turn") * 60)).alias("created_at_utc"),
        )

    @cached_property
    def chat_sessions(self) -> DataFrame:
        grouped = self.chat_messages.groupBy(F.col("session_id").alias("id")).agg(
            F.min("created_at_utc").alias("created_at_utc"), F.max("created_at_utc").alias("updated_at_utc")
        )
        title = F.when(F.col("id") % 3 == 0, F.lit("")).when(F.col("id") % 3 == 1, text("talk ", F.col("id").cast("string")))
        return grouped.select("id", title.alias("title"), (F.col("id") % 2 == 0).alias("is_active"), "created_at_utc", "updated_at_utc")

    @cached_property
    def news(self) -> DataFrame:
        start = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
        return self.given("documents").select(
            F.col("doc_id").alias("id"), F.substring_index("text", "\n", 1).alias("title"), F.col("text").alias("description"),
            F.col("source").alias("source_name"), text("https://example.com/n/", F.col("doc_id").cast("string")).alias("article_url"),
            (start + seconds(F.col("doc_id") * 977 % 2592000)).alias("published_at_utc"),
        )

    @cached_property
    def alerts(self) -> DataFrame:
        """Pages stand for the second news source."""
        start = F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")
        return self.given("pages").select(
            F.col("page_id").alias("id"), F.col("url").alias("title"), F.col("url").alias("description"),
            F.lit("alerts").alias("source_name"), F.col("url").alias("article_url"),
            (start + seconds(F.col("page_id") * 613 % 1296000)).alias("published_at_utc"),
        )

    @cached_property
    def news_links(self) -> DataFrame:
        """A document is about the instruments traded in the order of the same number."""
        doc = F.col("doc_id")
        # Joined first: only matching lines are left to make distinct, and they already lie together by document.
        pairs = self.given("lineitem").join(self.given("documents"), F.col("l_orderkey") == doc).select("doc_id", "l_suppkey").distinct()
        return (
            pairs.join(self.given("labels"), "doc_id", "left")
            .select(
                doc.alias("news_id"), F.when(doc % 11 == 0, "financial_alerts").otherwise("global_news").alias("news_source"),
                code_of("l_suppkey").alias("ts_code"), market_of("l_suppkey").alias("market"),
                ((doc * 31 % 100) / F.lit(1e2)).alias("confidence"),
                F.when(F.col("toxic") == 1, "risk").when(F.col("quality") == 1, "report").otherwise("other").alias("event_type"),
            )
        )

    @cached_property
    def execution_plans(self) -> DataFrame:
        """The last event of a user and day stands for that day's plan."""
        dated = self.given("events").withColumn("plan_date", F.to_date("ts"))
        return self._plan_columns(newest_row(dated, ["plan_date", "user_id"], ["ts", "event_id"]))

    @cached_property
    def plan_arrivals(self) -> DataFrame:
        """Every event as an arriving version of a plan."""
        return self._plan_columns(self.given("events").withColumn("plan_date", F.to_date("ts")), "ts", "event_id")

    @staticmethod
    def _plan_columns(e: DataFrame, *extra: str) -> DataFrame:
        value, n = F.col("value"), F.col("event_id")
        action = (
            F.when(F.col("event_type") == "purchase", "BUY_AT_OPEN").when(F.col("event_type") == "click", "BUY_ON_PULLBACK")
            .when(F.col("event_type") == "view", "WAIT_OBSERVE").when(F.col("event_type") == "signup", "SKIP_TODAY").otherwise("EXIT_SIGNAL")
        )
        return e.select(
            "plan_date", code_of("user_id").alias("ts_code"), text("Co", F.col("user_id").cast("string")).alias("name"),
            (n % 40 + 1).alias("rank"), F.when(n % 7 != 0, action).otherwise("").alias("open_action"),
            value.alias("predicted_buy"), F.when(n % 5 == 0, value * 0.98).when(n % 5 == 1, F.lit(0.0)).alias("adjusted_buy"),
            F.when(n % 4 == 0, (n % 9 - 4) / F.lit(1e2)).alias("overnight_adjustment"),
            F.when(n % 3 != 0, value).alias("auction_price"), F.when(n % 8 == 0, value * 1.01).alias("current_price"),
            (value * 1.1).alias("predicted_target"), (value * 0.9).alias("predicted_stop"),
            (value >= 69).alias("hit_target"), (value <= 14).alias("hit_stop"),
            F.when(n % 6 == 0, F.array(F.lit("⚠️ gap"), F.lit("watch"))).when(n % 6 == 1, F.array(F.lit("calm"))).alias("pre_market_notes"),
            F.when(n % 10 == 0, F.array(F.lit("touch"))).alias("intraday_notes"),
            *extra,
        )

    @cached_property
    def snapshot_folder(self) -> str:
        """Each day's plans as a stored file, in both accepted shapes; that of the 13th breaks off."""
        path = scratch_path(self.spark, "snapshots")
        day = F.dayofmonth("plan_date")
        lines = document_lines(self.execution_plans, ["rank", "ts_code"], day % 2 == 1).withColumn("_broken", F.endswith("plan_date", F.lit("-13")))
        lines = lines.filter("NOT _broken OR place = 1").withColumn("line", F.when(F.col("_broken"), "[{broken").otherwise(F.col("line")))
        write_snapshot_files(lines.drop("_broken"), path)
        return path

    @cached_property
    def watchlist(self) -> DataFrame:
        first = self.given("events").filter(F.col("event_type") == "view").groupBy("user_id").agg(F.min("ts").alias("created_at_utc"))
        return first.select(
            code_of("user_id").alias("ts_code"), market_of("user_id").alias("market"),
            F.when(F.col("user_id") % 4 == 0, "old note").alias("note"), (F.col("user_id") % 3 != 0).alias("enabled"), "created_at_utc",
        )

    @cached_property
    def watchlist_changes(self) -> DataFrame:
        e = newest_row(self.given("events").filter(F.col("event_type") == "click"), ["user_id"], ["ts", "event_id"])
        return e.select(
            code_of("user_id").alias("ts_code"), market_of("user_id").alias("market"),
            F.when(F.col("event_id") % 2 == 0, text("note ", F.col("event_id").cast("string"))).otherwise("").alias("note"),
            F.col("ts").alias("created_at_utc"),
        )

    @cached_property
    def watchlist_removals(self) -> DataFrame:
        """Users whose last event is an error."""
        e = newest_row(self.given("events"), ["user_id"], ["ts", "event_id"]).filter(F.col("event_type") == "error")
        return e.select(code_of("user_id").alias("ts_code"), market_of("user_id").alias("market"))

    @cached_property
    def model_requests(self) -> DataFrame:
        m = self.chat_messages.filter(F.col("role") == "user")
        # Every other question is one of a few that keep coming back.
        question = F.when(F.col("id") % 2 == 0, text("ask ", (F.col("id") % 20).cast("string"))).otherwise(F.col("content"))
        key = cache_key(F.lit(MODEL), F.lit(SYSTEM_PROMPT), question)
        return m.select(F.col("id").alias("request_id"), key.alias("cache_key"), F.col("created_at_utc").alias("asked_at"))

    @cached_property
    def cache_writes(self) -> DataFrame:
        """Every answer written to the cache, several per key where a question repeats."""
        late = F.col("asked_at") - seconds((F.col("request_id") % 7) * 1000)
        return self.model_requests.select(
            "cache_key", text('{"text":"', F.col("request_id").cast("string"), '"}').alias("response_json"),
            ((F.col("request_id") % 13 + 1) * 600).alias("ttl_seconds"), late.alias("created_at_utc"), "request_id",
        )

    @cached_property
    def company_profile_feed(self) -> DataFrame:
        """Profile versions as they arrive: one per supplier, a second one for some."""
        s, n = self.given("supplier"), F.col("s_suppkey")
        number = n.cast("string")
        suffix = F.when(n % 3 == 0, "股份有限公司").when(n % 3 == 1, "有限公司").otherwise("集团股份有限公司")
        unit = F.when(n % 3 == 0, "亿元").when(n % 3 == 1, "万元").otherwise("元")
        versions = s.withColumn("version", F.explode(F.when(n % 4 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))))
        return versions.select(
            code_of("s_suppkey").alias("ts_code"), market_of("s_suppkey").alias("market"),
            F.when(n % 5 != 0, text("K", number)).alias("key_no"), text("Co", number, suffix).alias("full_name"),
            text((F.floor(F.abs("s_acctbal"))).cast("string"), unit).alias("registered_capital"),
            F.when(F.col("version") == 2, "变更").otherwise("存续").alias("status"),
            F.when(n % 11 == 0, F.lit("000000")).otherwise(code_of("s_suppkey")).alias("stock_number"),
            F.date_add(F.lit("2024-01-01").cast("date"), F.col("version") * 30).alias("synced_on"),
        )

    @cached_property
    def company_shareholders(self) -> DataFrame:
        """Share of each customer segment in an instrument's yearly trade stands for a holding."""
        l, o, c = self.given("lineitem"), self.given("orders"), self.given("customer")
        year = F.trunc("l_shipdate", "year")
        seg = F.col("c_mktsegment")
        holder = (
            F.when(seg == "BUILDING", "国资控股").when(seg == "MACHINERY", "社保基金").when(seg == "AUTOMOBILE", "张三").otherwise(seg)
        )
        held = (
            l.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
            .join(c, F.col("o_custkey") == F.col("c_custkey"))
            .groupBy("l_suppkey", year.alias("synced_on"), holder.alias("shareholder_name"))
            .agg(F.sum("l_quantity").alias("held"))
        )
        total = F.sum("held").over(Window.partitionBy("l_suppkey", "synced_on"))
        return held.select(
            code_of("l_suppkey").alias("ts_code"), market_of("l_suppkey").alias("market"), "shareholder_name",
            F.round(F.col("held") * 100.0 / total, 4).alias("stock_percent"), "synced_on",
        )

    @cached_property
    def risk_rules(self) -> DataFrame:
        """The risk rules, kept in a file as a user would keep them."""
        path = scratch_path(self.spark, "strategy")
        risk_rules(self.spark, RISK_RULES).write.json(path)
        return risk_rules_file(self.spark, path)

    @cached_property
    def company_risk_events(self) -> DataFrame:
        """Every event as a risk event of its type, the amount being its value; the dates of a user lie up to 2000 days back."""
        kind = (
            F.when(F.col("event_type") == "error", "dishonest").when(F.col("event_type") == "purchase", "execution")
            .when(F.col("event_type") == "click", "abnormal").when(F.col("event_type") == "view", "court").otherwise("serious")
        )
        e = self.given("events")
        return e.select(
            F.col("event_id").alias("id"), code_of("user_id").alias("ts_code"), market_of("user_id").alias("market"), kind.alias("risk_type"),
            text("case ", F.col("event_id").cast("string")).alias("title"), F.col("value").alias("involved_amount"),
            F.date_sub(F.to_date("ts"), (F.col("user_id") * 37 % 2000).cast("int")).alias("event_date"), F.col("ts").alias("seen_at_utc"),
        )

    @cached_property
    def patents(self) -> DataFrame:
        """Returned lines stand for granted patents: (ts_code, patent id)."""
        l = self.given("lineitem").filter(F.col("l_returnflag") == "R")
        return l.select(code_of("l_suppkey").alias("ts_code"), market_of("l_suppkey").alias("market"), F.col("l_partkey").alias("patent_id"))

    @cached_property
    def business_scopes(self) -> DataFrame:
        """Brands with more than their even share of a supplier's lines, as one scope text per instrument."""
        b = self._brands(F.count("*"))
        scope = F.array_join(F.sort_array(F.collect_set("p_brand")), "、")
        return b.groupBy("l_suppkey").agg(scope.alias("business_scope")).select(
            code_of("l_suppkey").alias("ts_code"), market_of("l_suppkey").alias("market"), "business_scope"
        )


class ArrivingResearch(Research):
    """The same derivations over streams of the input tables; only row-wise ones apply to a stream."""

    def given(self, name: str) -> DataFrame:
        return input_stream(self.spark, self.folder, name)

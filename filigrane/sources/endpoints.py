"""The endpoint catalogue, and what fetches (symbol, endpoint) pairs in parallel tasks: a source, a stream, and a join to a table of symbols."""

from __future__ import annotations

import json
import time
from collections.abc import Iterable
from dataclasses import dataclass
from urllib.error import HTTPError
from urllib.parse import quote
from urllib.request import urlopen

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, In, InputPartition

from filigrane.operators import asking

# fixed values: endpoint paths by their operator
ENDPOINTS = {
    "search_stock_ticker": "/api/v1/stocks/search?q={symbol}",
    "quarterly_income": "/api/v1/stocks/{symbol}/income/quarterly",
    "annual_income": "/api/v1/stocks/{symbol}/income/annual",
    "quarterly_growth": "/api/v1/stocks/{symbol}/income/quarterly/growth",
    "annual_growth": "/api/v1/stocks/{symbol}/income/annual/growth",
    "balance_sheet": "/api/v1/stocks/{symbol}/balancesheet",
    "balancesheet_growth": "/api/v1/stocks/{symbol}/balancesheet/growth",
    "cash_flow": "/api/v1/stocks/{symbol}/cashflow",
    "stock_summary": "/api/v1/stocks/{symbol}/summary",
    "stock_peers": "/api/v1/stocks/{symbol}/peers",
    "dupont": "/api/v1/stocks/{symbol}/dupont",
    "solvency": "/api/v1/stocks/{symbol}/solvency",
    "liquidity": "/api/v1/stocks/{symbol}/liquidity",
    "capital_efficiency": "/api/v1/stocks/{symbol}/capital-efficiency",
    "cagr": "/api/v1/stocks/{symbol}/cagr",
    "full_financial_bundle": "/api/v1/stocks/{symbol}/financials",
}
#: Those whose whole answer is the payload, not what it has under `data`.
WHOLE = frozenset(("dupont", "solvency", "liquidity", "capital_efficiency", "cagr"))


def requests(symbols: DataFrame) -> DataFrame:
    """symbol, endpoint, path: what would be asked for every symbol, percent-encoded as UTF-8 (a slash stays, as in a path)."""
    paths = F.create_map(*(F.lit(x) for pair in ENDPOINTS.items() for x in pair))
    quoted = F.regexp_replace(F.regexp_replace(F.url_encode("symbol"), r"\+", "%20"), r"\*", "%2A")
    quoted = F.replace(F.replace(quoted, F.lit("%2F"), F.lit("/")), F.lit("%7E"), F.lit("~"))
    rows = symbols.select("symbol", quoted.alias("__q"), F.explode(paths).alias("endpoint", "path"))
    return rows.select("symbol", "endpoint", F.replace("path", F.lit("{symbol}"), "__q").alias("path"))


#: Answers that are worth another try.
AGAIN = (408, 429, 500, 502, 503, 504)


@dataclass(frozen=True)
class Asker:
    """Asks one endpoint: tries again after what may pass, waits as long as it is told to, and keeps to a rate."""

    base: str
    timeout: float = 20.0
    tries: int = 4
    wait: float = 0.5
    pause: float = 0.0  # seconds between two requests of a task

    def __call__(self, symbol: str, endpoint: str) -> tuple[str | None, str]:
        """payload, status of a pair; status is ok or begins with unavailable."""
        said = None
        for k in range(self.tries):
            time.sleep(self.pause)
            try:
                with urlopen(self.base + ENDPOINTS[endpoint].format(symbol=quote(symbol)), timeout=self.timeout) as answer:
                    said = json.load(answer)
                break
            except HTTPError as e:
                if e.code not in AGAIN or k + 1 == self.tries:
                    return None, f"unavailable: {type(e).__name__} {e.code}"
                told = e.headers.get("Retry-After", "")
                time.sleep(float(told) if told.replace(".", "", 1).isdigit() else self.wait * 2**k)
            except Exception as e:  # an endpoint that fails is a row, not a failed job
                if not isinstance(e, OSError) or k + 1 == self.tries:
                    return None, f"unavailable: {type(e).__name__}"
                time.sleep(self.wait * 2**k)
        if endpoint not in WHOLE:
            if not isinstance(said, dict) or not said.get("success"):
                return None, "unavailable"
            said = said.get("data")
        return json.dumps(said), "ok"

    def kept(self, symbol: str, endpoint: str) -> str | None:
        """The pair's answer as one text, to be kept; None if there is none yet."""
        payload, status = self(symbol, endpoint)
        return json.dumps([payload, status]) if status == "ok" else None


def fetched(symbols: DataFrame, base: str, answers: str, endpoints: Iterable[str] = tuple(ENDPOINTS), version: str = "", **how) -> DataFrame:
    """symbol, endpoint, payload, status of every pair of symbols (symbol) and endpoints, kept under answers.

    For tables of any number of symbols: pairs are dealt to tasks, and a pair that was answered under this version, say
    a date, is not asked again, whichever task, run or executor it was.  how: see Asker.
    """
    ask = Asker(base.rstrip("/"), **how).kept
    pairs = symbols.select("symbol").distinct().withColumn("endpoint", F.explode(F.array(*map(F.lit, endpoints))))
    told = F.from_json("answer", "array<string>")
    return asking.answered(pairs, ["symbol", "endpoint"], ask, answers, version).select("symbol", "endpoint", F.get(told, 0).alias("payload"), F.coalesce(F.get(told, 1), F.lit("unavailable")).alias("status"))


class Pairs(InputPartition):
    def __init__(self, pairs: list[tuple[str, str]], version: str = "", bucket: int = 0):
        self.pairs, self.version, self.bucket = pairs, version, bucket


class _Options:
    def __init__(self, options):
        self.asker = Asker(options.get("base", "").rstrip("/"), float(options.get("timeout", 20)), int(options.get("tries", 4)), float(options.get("wait", 0.5)), float(options.get("pause", 0)))
        self.symbols = [s for s in options.get("symbols", "").split(",") if s]
        self.endpoints = [e for e in options.get("endpoints", ",".join(ENDPOINTS)).split(",") if e]
        self.per_task = int(options.get("pairsPerTask", 16))

    def batches(self) -> list[list[tuple[str, str]]]:
        pairs = [(s, e) for s in self.symbols for e in self.endpoints]
        return [pairs[at : at + self.per_task] for at in range(0, len(pairs), self.per_task)]


class EndpointReader(DataSourceReader, _Options):
    """Batches of the pairs of the options."""

    def __init__(self, options):
        _Options.__init__(self, options)
        self.named = "symbols" in options

    def partitions(self):
        return [Pairs(b) for b in self.batches()]

    def read(self, partition: Pairs | None):
        for symbol, endpoint in partition.pairs if partition else ():  # None: there are no partitions
            yield symbol, endpoint, *self.asker(symbol, endpoint)


class PushedReader(EndpointReader):
    """Equality and IN on symbol and endpoint are taken over, so that only what is read is asked for.

    Without the option symbols, the symbols are those that the filters name.
    """

    def pushFilters(self, filters):
        for f in filters:
            name = f.attribute[0] if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 else None
            if name not in ("symbol", "endpoint"):
                yield f
                continue
            wanted = list(f.value) if isinstance(f, In) else [f.value]
            if name == "endpoint":
                self.endpoints = [e for e in self.endpoints if e in wanted]
            elif self.named:
                self.symbols = [s for s in self.symbols if s in wanted]
            else:
                self.symbols, self.named = list(dict.fromkeys(w for w in wanted if w is not None)), True


class EndpointStream(DataSourceStreamReader, _Options):
    """All pairs anew every so many seconds (option every). Offsets are rounds of the clock; answers of a round are kept (option answers), so that a round that is read again asks nothing twice."""

    def __init__(self, options):
        _Options.__init__(self, options)
        self.every, self.answers = float(options.get("every", 3600)), options["answers"]
        self.rounds = int(options.get("roundsPerBatch", 1))

    def initialOffset(self):
        return {"round": int(time.time() // self.every) - 1}

    def latestOffset(self):
        return {"round": int(time.time() // self.every)}

    def partitions(self, start, end):
        last = range(max(start["round"], end["round"] - self.rounds) + 1, end["round"] + 1)  # what was missed while stopped is not asked for each round
        return [Pairs(b, str(r), k) for r in last for k, b in enumerate(self.batches())]

    def read(self, partition: Pairs):
        log = asking.AnswerLog(f"{self.answers}/round={partition.version}", partition.bucket)
        known = log.known()
        missing = [(f"{s}/{e}", (s, e)) for s, e in partition.pairs if f"{s}/{e}" not in known]
        known |= asking.ask_all(missing, self.asker.kept, log)
        for symbol, endpoint in partition.pairs:
            payload, status = json.loads(known.get(f"{symbol}/{endpoint}", '[null, "unavailable"]'))
            yield symbol, endpoint, payload, status


class EndpointSource(DataSource):
    """spark.dataSource.register(EndpointSource), then format("endpoints") with base, symbols, endpoints, timeout, tries, wait, pause, pairsPerTask.

    As a stream also every and answers.  With the option pushdown=true filters are taken over, for which Spark wants
    spark.sql.python.filterPushdown.enabled to be true, as in a session of filigrane.session.
    """

    @classmethod
    def name(cls):
        return "endpoints"

    def schema(self):
        return "symbol string, endpoint string, payload string, status string"

    def reader(self, schema):
        return (PushedReader if self.options.get("pushdown", "").lower() == "true" else EndpointReader)(self.options)

    def streamReader(self, schema):
        return EndpointStream(self.options)

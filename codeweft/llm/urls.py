"""URL filters: a logistic regression on hashed character n-grams of host and path, after fixed rules.

The model is trained with pyspark.ml on a small labelled table. A URL's features are all runs of
NGRAMS characters of its host and of its path, each within boundary marks, hashed to BUCKETS places.
All digits count as one, as numbers of pages tell nothing. A run of the host weighs one over the root
of the host's number of runs, and so for the path: long paths don't drown the host.
Model size is BUCKETS doubles whatever the data. Rows are judged one by one in Arrow batches:
nothing shuffles, and a host that a third of all pages share does not matter."""
from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from .text import fold_ascii, fresh
from .words import mix

NGRAMS = (3, 4, 5)
BUCKETS = 1 << 14
SLICE_CHARS = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_EDGE = 0x110000                       # marks both ends of a host or path; no character has this number

# Verdict and host/path; a rule fits its host and all subdomains, and paths that begin with its path.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))

# Invented URLs on reserved domains, 1 for those to be blocked: gambling, pills, loans, adult, adverts, tracking, link
# farms, piracy, phishing and malware against ordinary sites. Both kinds share endings and path forms.
BLOCKED = """
http://casino-royal.test/en/12 https://www.lucky-casino.example.com/slots/5.html http://online-casino-bonus.test/play?ref=x
https://spin-casino.example.org/de/8841 http://m.mega-slots.test/win/77 https://slots-win.example.com/en/640.html
http://poker-stars-win.test/fr/3 https://free-poker.example.org/table/9 http://best-bets.test/en/112#top
https://bets-today.example.com/odds/31 http://sport-betting.test/es/18 https://win-big-money.example.org/now
http://jackpot-winner.test/claim/4 https://www.free-spins.example.com/en/56/ http://roulette-win.example.org/fr/90
http://cheap-meds.test/en/5 https://pills-online.example.com/order/88.html http://www.buy-pills.example.org/de/41
https://cheap-viagra-pills.test/es/6 http://discount-pharmacy.example.com/rx/7 https://no-prescription-meds.example.org/en/19
http://diet-pills-now.test/fr/23 https://slim-fast-pills.example.com/en/64?utm_source=feed http://herbal-cure.example.org/buy
http://quick-loans.test/apply/3 https://payday-loan.example.com/en/91 http://easy-cash-loans.example.org/de/14
https://fast-credit-approved.test/es/2 http://debt-free-now.example.com/offer https://instant-cash.example.org/en/77.html
http://hot-adult-cams.test/live/5 https://xxx-videos.example.com/en/34 http://sexy-singles.example.org/meet/8
https://adult-dating.test/fr/61 http://free-xxx-cams.example.com/de/12 https://hookup-tonight.example.org/en/4
http://ads-server.test/banner/9 https://popup-ads.example.com/en/1?page=2 http://www.ad-click.example.org/fr/450
https://banner-ads-network.test/show http://click-track.example.com/en/73#top https://track-pixel.example.org/p/5.gif
http://ads-tracker.test/de/930 https://tracking-clicks.example.com/es/11 http://adserv-popunder.example.org/go
https://affiliate-clicks.test/en/82/ http://promo-track.example.com/r/19 https://pay-per-click-ads.example.org/fr/5
http://link-farm.test/en/10 https://seo-links-cheap.example.com/buy/3 http://spam-links.example.org/de/58
https://backlink-farm.test/fr/7 http://spam-mailer.example.com/en/204 https://bulk-email-spam.example.org/es/17
http://content-farm-spam.test/en/39.html https://comment-spam.example.com/post/6 http://traffic-farm.example.org/en/880
http://free-warez.test/dl/4 https://cracked-software.example.com/en/21 http://keygen-crack.example.org/de/66
https://free-movie-stream.test/watch/8 http://torrent-warez.example.com/fr/95 https://serial-cracks.example.org/en/2
http://verify-your-account.test/login https://secure-bank-login.example.com/update/7 http://paypa1-security.example.org/en/13
https://prize-claim-winner.test/es/5 http://free-gift-cards.example.com/en/48 https://iphone-winner.example.org/claim/1
http://free-download-virus.test/exe/3 https://fix-your-pc-now.example.com/en/71 http://malware-dropper.example.org/de/9
https://replica-watches.test/en/15 http://cheap-replica-bags.example.com/fr/33 https://fake-designer-outlet.example.org/es/27
http://blog.xxx-pics.test/en/3367 https://win-prizes.example.com/de/2069.html
http://earn-money-fast.test/en/62 https://get-rich-quick.example.com/join/4 http://work-from-home-cash.example.org/de/37
https://crypto-doubler.test/en/8 http://bitcoin-giveaway.example.com/fr/52 https://forex-win-signals.example.org/en/101
""".split()
ALLOWED = """
http://hillside-library.test/en/12 https://www.nordwind.example.com/berichte/5.html http://open-atlas.test/maps?ref=x
https://rivermouth.example.org/de/8841 http://m.karlstadt.test/stadt/77 https://bookshelf.example.com/en/640.html
http://lesoir-du-lac.test/fr/3 https://kitchen-notes.example.org/recipes/9 http://weather-station.test/en/112#top
https://old-town-museum.example.com/exhibits/31 http://periodico-sur.test/es/18 https://train-times.example.org/now
http://school-of-music.test/courses/4 https://www.bird-watchers.example.com/en/56/ http://jardin-botanique.example.org/fr/90
http://city-council.test/en/5 https://health-institute.example.com/papers/88.html http://www.baumhaus.example.org/de/41
https://universidad-norte.test/es/6 http://family-doctor.example.com/clinic/7 https://hospital-guide.example.org/en/19
http://maison-verte.test/fr/23 https://running-club.example.com/en/64?utm_source=feed http://green-grocer.example.org/shop
http://national-bank-museum.test/visit/3 https://public-records.example.com/en/91 http://sparverein.example.org/de/14
https://biblioteca-central.test/es/2 http://charity-fund.example.com/donate https://savings-history.example.org/en/77.html
http://theatre-live.test/plays/5 https://film-archive.example.com/en/34 http://chess-society.example.org/meet/8
https://poesie-moderne.test/fr/61 http://tanzschule.example.com/de/12 https://evening-classes.example.org/en/4
http://code-review.test/docs/9 https://software-manuals.example.com/en/1?page=2 http://www.la-gazette.example.org/fr/450
https://network-engineers.test/forum http://mountain-trails.example.com/en/73#top https://photo-prints.example.org/p/5.gif
http://wetterdienst.test/de/930 https://mercado-central.example.com/es/11 http://harbour-master.example.org/log
https://physics-letters.test/en/82/ http://papers-archive.example.com/r/19 https://histoire-locale.example.org/fr/5
http://farmers-market.test/en/10 https://garden-tools.example.com/buy/3 http://dorfleben.example.org/de/58
https://ecole-primaire.test/fr/7 http://mailing-list.example.com/en/204 https://correo-literario.example.org/es/17
http://dairy-farm.test/en/39.html https://reader-letters.example.com/post/6 http://traffic-reports.example.org/en/880
http://free-encyclopedia.test/wiki/4 https://software-guide.example.com/en/21 http://handwerk.example.org/de/66
https://river-stream-ecology.test/watch/8 http://cuisine-du-monde.example.com/fr/95 https://serial-fiction.example.org/en/2
http://student-portal.test/login https://central-bank.example.com/update/7 http://security-research.example.org/en/13
https://premio-literario.test/es/5 http://gift-shop-museum.example.com/en/48 https://phone-repairs.example.org/help/1
http://download-mirror.test/iso/3 https://computer-history.example.com/en/71 http://werkstatt.example.org/de/9
https://clockmakers.test/en/15 http://sacs-en-cuir.example.com/fr/33 https://diseno-grafico.example.org/es/27
http://economics-today.test/en/62 https://careers-advice.example.com/join/4 http://heimarbeit-geschichte.example.org/de/37
https://thornton.test/en/8 http://ardennes.example.com/fr/52 https://signal-processing.example.org/en/101
https://thornbury.test/en/3367 http://blog.terrin.example.com/de/2069.html
""".split()
LABELLED = tuple((u, 1) for u in BLOCKED) + tuple((u, 0) for u in ALLOWED)


def host_of(url: Column) -> Column:
    """Between the first "://" and the next "/", "?", "#" or end, A-Z in lower case; else ""."""
    return fold_ascii(F.regexp_extract(_rest(url), "^[^/?#]*", 0))


def path_of(url: Column) -> Column:
    """From the end of the host to the next "?", "#" or end."""
    rest = _rest(url)
    return F.regexp_extract(F.substr(rest, F.length(F.regexp_extract(rest, "^[^/?#]*", 0)) + 1), "^[^?#]*", 0)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.coalesce(F.when(at > 0, F.substr(url, at + 3)), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """(verdict, rule) of the longest rule that fits, null if none does. Of rules of one length the
    first given wins. `rules` is a list written into the plan, of some hundreds at most."""
    def fits(rule):
        rule_host, slash, rule_path = rule.partition("/")
        if not rule_host:
            raise ValueError(f"rule without a host: {rule!r}")
        return ((host == rule_host) | F.endswith(host, F.lit(f".{rule_host}"))) & F.startswith(path, F.lit(slash + rule_path))
    found = [F.when(fits(rule), F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule")))
             for verdict, rule in sorted(rules, key=lambda r: -len(r[1]))]
    return F.coalesce(*found) if found else F.lit(None).cast("struct<verdict:string,rule:string>")


def _grams(strings: pa.Array, seed: int, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, bucket) of every n-gram of every string, a slice of rows at a time. A string is handled whole."""
    lengths = pc.utf8_length(strings).to_numpy().astype(np.int64)
    ends, i = np.cumsum(lengths + 2), 0
    while i < len(strings):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + SLICE_CHARS, "right")))
        chars = np.concatenate([np.concatenate(([_EDGE], np.frombuffer(s.as_py().encode("utf-32-le", "surrogatepass"), np.uint32), [_EDGE]))
                                for s in strings.slice(i, j - i)]).astype(np.uint64)
        row = np.repeat(np.arange(i, j), lengths[i:j] + 2)
        hashes = np.full(len(chars), seed, np.uint64)
        for n in range(1, max(NGRAMS) + 1):
            if len(chars) < n:
                break
            hashes = hashes[:len(chars) - n + 1] * _BASE + mix(chars[n - 1:] + np.uint64(n))
            if n in NGRAMS:
                whole = row[:len(hashes)] == row[n - 1:]
                yield row[:len(hashes)][whole], (mix(hashes[whole]) % np.uint64(buckets)).astype(np.int64)
        i = j


def features(hosts: pa.Array, paths: pa.Array, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket, value) of the features of some URLs, A-Z folded; a bucket may come more than once."""
    rows, places, values = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
    for seed, strings in ((1, hosts), (2, paths)):
        folded = pc.replace_substring_regex(pc.ascii_lower(strings), "[0-9]", "0")
        parts = list(_grams(folded, seed, buckets))
        total = sum((np.bincount(row, minlength=len(strings)) for row, _ in parts), np.zeros(len(strings), np.int64))
        for row, place in parts:
            rows.append(row)
            places.append(place)
            values.append(1 / np.sqrt(total[row]))
    return np.concatenate(rows), np.concatenate(places), np.concatenate(values)


class Model(NamedTuple):
    weights: np.ndarray
    intercept: float

    def probability(self, hosts: pa.Array, paths: pa.Array) -> np.ndarray:
        row, bucket, value = features(hosts, paths, len(self.weights))
        margin = self.intercept + np.bincount(row, self.weights[bucket] * value, minlength=len(hosts))
        return 1 / (1 + np.exp(-margin))


def train(spark: SparkSession, labelled: Sequence[tuple[str, int]] = LABELLED, buckets: int = BUCKETS,
          regularisation: float = 1e-4, iterations: int = 100) -> Model:
    """A logistic regression on `labelled` (url, 1 to block or 0), a small table on the driver."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.linalg import Vectors
    urls = spark.createDataFrame([(i, u, float(y)) for i, (u, y) in enumerate(labelled)], "i int, url string, label double")
    rows = urls.select("i", "label", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")).orderBy("i").collect()
    at, bucket, value = features(pa.array([r.host for r in rows], pa.string()), pa.array([r.path for r in rows], pa.string()), buckets)
    table = []
    for i, r in enumerate(rows):
        places, which = np.unique(bucket[at == i], return_inverse=True)
        table.append((Vectors.sparse(buckets, places.tolist(), np.bincount(which, value[at == i]).tolist()), r.label))
    fitted = LogisticRegression(maxIter=iterations, regParam=regularisation, standardization=False).fit(
        spark.createDataFrame(table, ["features", "label"]).coalesce(1))
    return Model(fitted.coefficients.toArray(), float(fitted.intercept))


def judge_urls(pages: DataFrame, url: str = "url", rules: Sequence[tuple[str, str]] = RULES, model: Model | None = None,
               threshold: float = 0.5) -> DataFrame:
    """`pages` plus `host`, `path`, `rule` (the longest that fits, else null), `p_block` (the model's
    probability) and `verdict` ("allow" or "block": the rule's, else "block" from `threshold` on).

    A null url and one without "://" have an empty host and path, and the model judges these. One row
    in, one row out; an empty table gives no rows. Other columns pass through, but columns named like
    the five new ones are replaced."""
    model = model or train(pages.sparkSession)
    made = ("host", "path", "rule", "p_block", "verdict")
    keep = [c for c in pages.columns if c not in made]
    host, path, block = fresh(pages.columns, "host", "path", "block")
    given = pages.select(*[F.col(f"`{c}`") for c in keep], host_of(F.col(f"`{url}`")).alias(host), path_of(F.col(f"`{url}`")).alias(path))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = model.probability(batch.column(host), batch.column(path))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p)], names=[*batch.schema.names, block])

    (found,) = fresh([*keep, host, path, block], "found")
    judged = given.mapInArrow(score, StructType([*given.schema]).add(block, "double")).withColumn(found, rule_of(F.col(host), F.col(path), rules))
    verdict = F.coalesce(F.col(f"{found}.verdict"), F.when(F.col(block) >= threshold, "block").otherwise("allow"))
    return judged.select(*[F.col(f"`{c}`") for c in keep], F.col(host).alias("host"), F.col(path).alias("path"),
                         F.col(f"{found}.rule").alias("rule"), F.col(block).alias("p_block"), verdict.alias("verdict"))


def op12(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge_urls(pages).select("page_id", "host", "path", "rule", "verdict", "p_block")

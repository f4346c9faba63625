"""URL filters: rules, then logistic regression on hashed character n-grams of host and path. All of it built-in expressions.

Training takes a small labelled table (MAX_LABELLED rows at most, else ValueError): it is one row of arrays, the
similarities of its URLs are the kernel, and full-batch gradient descent runs in an `aggregate` over that row. What comes
out is one weight for each of BUCKETS buckets. Scoring is a sum over a URL's n-grams, in the scan itself.

Null URLs and those without `://` have empty host and path; their score is the intercept's. Repeated rows and ties are judged
row by row. Rows of the labelled table with a null URL or label don't teach; one without rows gives a score of 0.5, which
is allowed. Other columns pass untouched by `judged`.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import saved

MAX_LABELLED = 500
BUCKETS, GRAM, STEPS, RATE, DECAY = 16384, (2, 4), 200, 8.0, 0.0005

# The rules of the query, as (verdict, host, path).
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))

# The small labelled table that the query trains on. Wanted: public sites of reference, news, science, government,
# culture and software. Unwanted: made-up names of the kinds that public block lists name (gambling, adult, pharmacy
# spam, piracy, scams, advertising), with beginnings and ends in turn. No host of a test table is among them.
WANTED = (
    "en.wikipedia.org en.wiktionary.org archive.org arxiv.org www.nature.com www.sciencedirect.com www.jstor.org www.nasa.gov www.noaa.gov www.nih.gov www.cdc.gov www.who.int "
    "www.un.org europa.eu www.loc.gov www.si.edu web.mit.edu www.stanford.edu www.harvard.edu www.berkeley.edu www.ox.ac.uk www.cam.ac.uk ethz.ch home.cern "
    "www.bbc.co.uk www.theguardian.com www.nytimes.com www.washingtonpost.com www.reuters.com apnews.com www.lemonde.fr www.spiegel.de elpais.com www.corriere.it www.npr.org www.pbs.org "
    "www.economist.com docs.python.org www.rust-lang.org go.dev www.kernel.org www.gnu.org www.debian.org ubuntu.com developer.mozilla.org www.w3.org www.ietf.org www.apache.org "
    "github.com gitlab.com stackexchange.com readthedocs.io www.postgresql.org www.sqlite.org www.britannica.com www.gutenberg.org openlibrary.org www.worldcat.org www.nationalgeographic.com "
    "www.smithsonianmag.com www.science.org www.pnas.org plos.org link.springer.com onlinelibrary.wiley.com dl.acm.org www.ieee.org www.ams.org www.aps.org www.rsc.org www.mayoclinic.org "
    "www.weather.gov www.usgs.gov www.epa.gov www.census.gov data.gov www.gov.uk www.parliament.uk www.legislation.gov.uk www.bundestag.de www.admin.ch www.canada.ca www.australia.gov.au "
    "www.nps.gov www.metmuseum.org www.louvre.fr www.rijksmuseum.nl www.moma.org www.tate.org.uk www.allrecipes.com www.seriouseats.com www.kingarthurbaking.com www.ravelry.com "
    "www.imdb.com www.goodreads.com www.lonelyplanet.com www.openstreetmap.org www.chess.com www.espn.com www.olympics.com medium.com wordpress.org www.khanacademy.org www.coursera.org "
    "www.edx.org www.duolingo.com www.scientificamerican.com www.newscientist.com www.theatlantic.com www.newyorker.com www.ft.com www.bloomberg.com www.lefigaro.fr www.liberation.fr "
    "www.faz.net www.sueddeutsche.de www.zeit.de www.elmundo.es www.abc.es www.repubblica.it www.asahi.com www.abc.net.au www.cbc.ca www.rte.ie www.scielo.br www.redalyc.org "
    "www.gardenersworld.com www.rhs.org.uk www.mathworks.com mathoverflow.net www.physicsforums.com www.biography.com www.history.com www.poetryfoundation.org www.philosophynow.org "
    "www.cookinglight.com www.runnersworld.com www.cyclingnews.com www.birdlife.org www.nationaltrust.org.uk www.britishmuseum.org www.vam.ac.uk www.bl.uk www.bnf.fr www.dnb.de "
    "www.crossref.org pubmed.ncbi.nlm.nih.gov www.ebi.ac.uk www.ensembl.org www.rcsb.org www.genome.gov www.cancer.org www.heart.org www.redcross.org www.unicef.org www.unesco.org "
    "www.worldbank.org www.imf.org www.oecd.org www.ecb.europa.eu www.federalreserve.gov www.consumerreports.org www.php.net sourceforge.net www.researchgate.net www.speedtest.net www.behance.net stackoverflow.blog www.bmj.com www.thelancet.com www.cell.com www.frontiersin.org"
).split()
UNWANTED = (
    "royalcasinoslots megaslotsbonus pokerjackpot777 playroulettelive luckyslots24 vegascasinoclub bestbettingtips sportsbookwinner blackjackbonus bingojackpots "
    "onlineslotmachines freespinscasino lottowinnersclub highrollerpoker betandwinbig cryptocasinobonus slotsofgold jackpotcity777 roulettesystem pokerchipsfree "
    "hotxxxvideos freepornhub24 sexcamsclub nudegirlslive adultdatingnow xxxmoviesfree sexychatrooms escortgirls24 pornstarsclub hotmilfcams "
    "nakedcamgirls xxxtubefree adultwebcams sexvideoshd eroticmassage24 hentaixxx livesexshow freesexdating pornvideosfree hookupsexclub "
    "buyviagraonline cheapcialis24 discountpharmacyrx noprescriptionmeds genericviagrashop orderxanaxonline weightlosspillsnow buysteroidsonline dietpillsdiscount onlinepharmacycheap "
    "tramadolnorx cheapviagradeals penisenlargepills miraclefatburner buycheapmedsonline rxpillstore ketodietpills slimmingpillsoffer pillshop24 canadianmedsrx "
    "freetorrentmovies warezcracks keygenserials crackedsoftwarefree nulledscripts moviestreamfree24 torrentwarez serialkeysfree cracksdownload pirategames24 "
    "fullcrackkeygen freemoviestorrents downloadwarez24 hackedgamesfree modapkcracked "
    "paydayloansfast quickcashloans24 getrichquicknow makemoneyfast24 bitcoindoubler cryptoprofitbot freeiphonewinner claimyourprize freegiftcards24 workfromhomecash "
    "replicawatchesshop fakerolexdeals luxuryreplicabags cheapreplicas instantcashwinner forexprofitsignals binaryoptionswin easyloansapproved winfreemoneynow doubleyourbitcoin "
    "bestadsnetwork popunderads24 adclicktracker trackclicksnow adservercdn24 bannerexchange clickbaittraffic buybacklinkscheap seolinkfarm instantfollowers24 "
    "cheaptrafficbot spamblaster bulkemailspam trackingpixelads popupadserver buyfollowerscheap linkexchangefarm autoclickbot fakereviewsshop massmailerspam"
).split()
_STARTS, _ENDS = ("www.", "", "www.", "m."), (".com", ".org", ".net", ".co.uk", ".com", ".info", ".de", ".org", ".fr", ".com", ".edu", ".it", ".eu")
_GOOD_PATHS, _BAD_PATHS = ("/wiki/Main_Page", "/articles/2019/05/report", "/about", "/research/publications.html", "", "/docs/tutorial/intro"), ("/free-bonus", "/buy-now", "/signup-today", "/hot/videos", "", "/download/full-version")

#: (label, url), 1 for unwanted: a URL of each host.
LABELLED = tuple(
    [(1, f"http{'s' * (i % 2)}://{_STARTS[i % 4]}{h}{_ENDS[i % 13]}{_BAD_PATHS[i % 6]}") for i, h in enumerate(UNWANTED)] + [(0, f"http{'s' * (i % 2)}://{h}{_GOOD_PATHS[i % 6]}") for i, h in enumerate(WANTED)]
)


def host(url: Column) -> Column:
    rest = F.substring_index(url, "://", 1)
    rest = F.substr(url, F.length(rest) + 4, F.length(url))
    found = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(F.coalesce(url.contains("://"), F.lit(False)), found).otherwise(F.lit(""))


def path(url: Column) -> Column:
    rest = F.substring_index(url, "://", 1)
    rest = F.substr(url, F.length(rest) + 4, F.length(url))
    return F.when(F.coalesce(url.contains("://"), F.lit(False)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)).otherwise(F.lit(""))


def grams(h: Column, p: Column) -> Column:
    """Buckets of the different n-grams of host and path, each padded and marked as its own kind."""
    def of(mark: str, text: Column, n: int) -> Column:
        padded = F.concat(F.lit("^"), text, F.lit("$"))
        places = F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(padded) - n + 1))
        return F.when(F.length(padded) >= n, F.transform(places, lambda i: F.concat(F.lit(mark), F.substr(padded, i, F.lit(n))))).otherwise(F.array().cast("array<string>"))

    every = F.array_distinct(F.concat(*[of(mark, text, n) for mark, text in (("h", h), ("p", p)) for n in range(GRAM[0], GRAM[1] + 1)]))
    return F.when((h == "") & (p == ""), F.array().cast("array<int>")).otherwise(F.array_distinct(F.transform(every, lambda g: F.pmod(F.xxhash64(g), F.lit(BUCKETS)).cast("int"))))


@dataclass(frozen=True)
class Model:
    weights: tuple[float, ...]
    intercept: float

    def score(self, h: Column, p: Column) -> Column:
        """Probability of label 1."""
        weights = F.split(F.lit(",".join(map(repr, self.weights))), ",").cast("array<double>")
        total = F.aggregate(grams(h, p), F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("n")), lambda a, g: F.struct((a["sum"] + F.element_at(weights, g + 1)).alias("sum"), (a["n"] + 1).alias("n")), lambda a: a["sum"] / F.sqrt(F.greatest(a["n"], F.lit(1)).cast("double")))
        return 1 / (1 + F.exp(-(F.lit(self.intercept) + total)))


def labelled(spark: SparkSession, rows=LABELLED) -> DataFrame:
    return spark.createDataFrame([(u, y) for y, u in rows], "url string, label int")


def split(rows=LABELLED) -> tuple[list[tuple[int, str]], list[tuple[int, str]]]:
    """The labelled rows that teach and those of a fourth of the hosts, by the hash of the host's name, that are held out."""
    held = [zlib.crc32(u.split("/")[2].encode()) % 4 == 0 for _, u in rows]
    return [r for r, h in zip(rows, held, strict=True) if not h], [r for r, h in zip(rows, held, strict=True) if h]


def train(rows: DataFrame) -> Model:
    """Logistic regression from (url, label)."""
    rows = rows.where("url is not null and label in (0, 1)").select("url", F.col("label").cast("double").alias("y"))
    n = rows.count()
    if n > MAX_LABELLED:
        raise ValueError(f"{n} labelled URLs; this trains on {MAX_LABELLED} at most")
    if not n:
        return Model((0.0,) * BUCKETS, 0.0)
    rows = rows.select(grams(host(F.col("url")), path(F.col("url"))).alias("x"), "y", "url")
    one = rows.agg(F.sort_array(F.collect_list(F.struct("url", "y", "x"))).alias("rows"))  # MAX_LABELLED rows at most
    kernel = F.transform("rows", lambda a: F.transform("rows", lambda b: F.size(F.array_intersect(a["x"], b["x"])) / F.sqrt(F.greatest(F.size(a["x"]) * F.size(b["x"]), F.lit(1)).cast("double"))))
    one = saved(one.select("rows", kernel.alias("kernel")))  # else each step would make the kernel again
    zero = F.struct(F.transform("rows", lambda r: F.lit(0.0)).alias("a"), F.lit(0.0).alias("b"))

    def step(now: Column, _: Column) -> Column:
        margin = lambda row: F.aggregate(F.zip_with(row, now["a"], lambda k, a: k * a), now["b"], lambda s, v: s + v)
        wrong = F.transform("kernel", lambda row, i: 1 / (1 + F.exp(-margin(row))) - F.element_at("rows", i + 1)["y"])
        moved = F.transform(F.array(wrong), lambda e: F.struct(F.zip_with(now["a"], e, lambda a, v: a - RATE / n * 10 * v - DECAY * a).alias("a"), (now["b"] - RATE / n * F.aggregate(e, F.lit(0.0), lambda s, v: s + v)).alias("b")))
        return F.element_at(moved, 1)

    fitted = one.select("rows", F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), zero, step).alias("fit"))
    of = fitted.select(F.col("fit.b").alias("b"), F.explode(F.arrays_zip("rows", F.col("fit.a").alias("a"))).alias("r"))
    of = of.select("b", F.col("r.a").alias("a"), F.col("r.rows.x").alias("x"))
    parts = of.select("b", F.explode(F.when(F.size("x") > 0, F.col("x")).otherwise(F.array(F.lit(0)))).alias("k"), F.when(F.size("x") > 0, F.col("a") / F.sqrt(F.size("x").cast("double"))).otherwise(F.lit(0.0)).alias("w"))
    got = parts.groupBy("k").agg(F.sum("w").alias("w"), F.first("b").alias("b")).collect()  # BUCKETS rows at most
    weights = [0.0] * BUCKETS
    for r in got:
        weights[r["k"]] = round(r["w"], 9)
    return Model(tuple(weights), round(got[0]["b"], 9))


def rule(h: Column, p: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, or nulls."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, host_, path_ in sorted(rules, key=lambda r: (len(r[1] + r[2]), len(r[1]), r)):
        fits = ((h == host_) | h.endswith("." + host_)) & p.startswith(path_)
        name, verdict = F.when(fits, F.lit(host_ + path_)).otherwise(name), F.when(fits, F.lit(what)).otherwise(verdict)
    return name, verdict


def judged(pages: DataFrame, model: Model, rules=RULES, threshold: float = 0.5) -> DataFrame:
    """`pages` with host, path, rule, score and verdict; columns of these names are replaced."""
    url = F.col("url")
    h, p = host(url), path(url)
    name, verdict = rule(h, p, rules)
    score = model.score(h, p)
    return pages.withColumns({"host": h, "path": p, "rule": name, "score": score, "verdict": F.coalesce(verdict, F.when(score > threshold, "block").otherwise("allow"))})


def parts(pages: DataFrame) -> DataFrame:
    """(page_id, host, path, rule, rule_verdict) of every row: what the rules say, without the model."""
    h, p = host(F.col("url")), path(F.col("url"))
    name, verdict = rule(h, p)
    return pages.select("page_id", h.alias("host"), p.alias("path"), name.alias("rule"), verdict.alias("rule_verdict"))


def report(pages: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict, score) of every row."""
    model = train(labelled(pages.sparkSession) if rows is None else rows)
    return judged(pages.select("page_id", "url"), model).select("page_id", "host", "path", "rule", "verdict", F.round("score", 6).alias("score"))

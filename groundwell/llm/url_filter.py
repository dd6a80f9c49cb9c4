"""URL verdicts: prefix rules first, else logistic regression on hashed character n-grams.

Host and path are cut from the URL; a rule holds for its host and every subdomain if the path
starts with the rule's, and the longest rule wins. Other URLs get the verdict of a logistic
regression over hashed n-grams of "host|path", trained from a small labelled URL table. Scoring is a
DataFrame expression; only the labelled table, of at most ``MAX_LABELLED`` rows, reaches the driver.

Defined cases: a null URL or one without "://" has an empty host and path, no rule and the verdict
of the empty string; of equally long rules the greater in order wins; very long URLs are judged whole;
repeated rows and null ids give results of their own; an empty table gives an empty result; without
labelled rows every URL scores 0.5 and is blocked unless a rule allows it; extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 4096
MAX_LABELLED = 10_000
#: host, path, verdict.
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
#: The small labelled table, written by hand: URLs whose pages are wanted, and URLs of spam, adult, gambling, tracking and phishing pages.
SEED_URLS = {
    "allow": """
        https://en.encyclopedia.net/wiki/History_of_printing https://docs.library.edu/guide/catalogue https://news.daily.net/politics/2021/05/election-results
        https://blog.science.net/2019/quantum-basics https://www.museum.net/collections/paintings/312 https://archive.school.edu/maths/algebra.html
        https://research.university.edu/papers/2104.pdf https://wiki.community.net/en/Main_Page https://www.cityhall.gov/services/waste http://weather.national.gov/forecast/today
        https://www.gardening.net/tips/roses https://recipes.kitchen.net/soups/lentil http://forum.woodworking.net/t/joints/98 https://www.chess.club/lessons/openings
        https://developer.platform.dev/docs/install https://code.hosting.dev/project/readme https://manual.database.dev/en/sql-select.html https://tutorials.python.dev/lists
        https://www.hospital.health/patients/visiting https://medlibrary.health/asthma/overview https://www.bookshop.net/authors/biography https://poems.literature.net/spring/12
        https://www.railways.travel/timetable/north http://maps.hiking.travel/trail/45 https://www.theatre.events/programme/autumn https://concerts.music.net/reviews/2018
        https://parliament.gov/debates/2020-11-03 https://statistics.gov/tables/population.csv https://law.court.gov/opinions/1998/22 https://www.farmers.coop/markets
        https://blog.traveller.net/fr/voyage/lyon http://www.journal.net/de/wissen/sterne https://revista.cultura.net/es/cine/42 https://www.zeitung.net/de/politik/712.html
        http://www.lemonde-local.net/fr/societe/65.html https://noticias.region.net/es/deportes/18 https://www.encyclopedie.net/fr/histoire/31 https://biblioteca.ciudad.net/es/libros
        https://m.news.net/en/world/120 http://blog.photography.net/en/portraits/327 https://www.astronomy.net/en/planets/mars https://kids.learning.edu/spelling
        https://www.observatory.edu/data/2017/ http://physics.college.edu/lectures/week3 https://library.town.gov/opening-hours https://www.choir.community/rehearsals
        https://openaccess.journals.net/article/10/22 https://www.bicycle.repair/guides/brakes http://birds.nature.net/species/wren https://www.geology.net/rocks/granite
        https://www.baking.net/bread/sourdough https://history.archive.net/letters/1912 https://www.football.league/table/2022 https://school.district.edu/calendar
        https://answers.programming.dev/questions/4512/sort-a-list https://www.orchestra.events/season https://ocean.research.net/tides http://www.translation.net/dictionary/word
        https://www.volunteers.community/about https://energy.agency.gov/reports/solar https://en.example.net/658.html http://blog.example.net/en/229
        https://www.firefighters.gov/safety https://stories.children.net/the-fox http://www.painters.gallery/exhibition/7 https://economy.review.net/2016/trade
    """,
    "block": """
        http://casino-bonus.net/win/free https://free-pills-shop.biz/cheap/pills/ http://adult.xxx-cams.net/adult/xxx https://win-prize.click/claim?ref=spam
        http://cheap-loans.info/apply/now https://track.ads-server.net/click?utm_source=ads http://login-verify.top/login/verify.php https://torrent-crack.net/download/crack.exe
        http://cheap-pills.net/order/online https://best-casino-slots.bet/jackpot http://poker-bonus.bet/free-spins https://sexy-girls.xxx/live http://hot-cams.xxx/webcam/1
        https://buy-viagra-online.biz/discount http://replica-watches.shop/rolex/cheap https://free-iphone-winner.click/prize http://secure-bank-login.top/account/verify
        https://crypto-doubler.win/invest http://miracle-diet-pills.biz/lose-weight https://ad.doubleclicker.net/banner?id=9 http://popunder-ads.net/redirect?to=1
        https://warez-keygen.to/serial/download http://cracked-games.to/torrent/55 https://payday-loans-fast.info/cash http://earn-money-home.biz/easy
        https://xxx-videos.tube/porn/22 http://porn-free.tube/watch/7 https://escort-city.xxx/girls http://betting-tips.bet/odds/win https://slots-free-spins.casino/play
        http://online-casino-bonus.casino/deposit https://cheap-meds.pharmacy-online.biz/pills http://spam-links.click/buy?aff=12 https://seo-backlinks.cheap/buy
        http://verify-paypa1.top/signin.php https://account-update-required.top/login http://free-gift-card.click/win https://survey-prize.win/claim http://adserver.tracker.click/pixel?id=1
        https://click-track.ads.net/r?u=3 http://pop-ads.click/open https://cheap-viagra.biz/order http://pills-online.shop/buy/cheap https://casino-royal.bet/bonus
        http://www.cheap-pills.net/en/450?page=2 https://www.casino-win.net/en/12 http://www.free-porn.net/de/9 https://www.bonus-slots.net/fr/31 http://m.xxx-cams.net/es/4
        https://hack-tool.to/crack/keygen http://download-crack.to/serial.exe https://fake-rolex.shop/replica http://lottery-winner.win/claim-prize https://loan-approval.info/instant
        http://dating-hot-girls.xxx/join https://sex-chat.xxx/cams http://gambling-bonus.bet/roulette https://free-bitcoin.win/double http://forex-profit.win/guaranteed
        https://weight-loss-miracle.biz/buy http://work-from-home-cash.biz/earn https://phish-login.top/verify/account http://banner-ads.net/click?cid=8
    """,
}


def seed_table(spark: SparkSession) -> DataFrame:
    """(url, label): label 1 blocks."""
    rows = [f"('{url}', {int(verdict == 'block')})" for verdict, urls in SEED_URLS.items() for url in urls.split()]
    return spark.sql(f"SELECT * FROM VALUES {', '.join(rows)} AS t(url, label)")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first "://" up to / ? # or the end, A-Z lower-cased. Path: then up to ? # or the end."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    raw = F.coalesce(F.regexp_extract(rest, "^[^/?#]*", 0), F.lit(""))
    after = F.coalesce(F.substring(rest, F.length(raw) + 1, F.length(rest)), F.lit(""))
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(raw, letters, letters.lower()), F.regexp_extract(after, "^[^?#]*", 0)


def ngram_buckets(host: Column, path: Column, sizes=(3, 4, 5), buckets: int = BUCKETS) -> Column:
    """Bucket of each character n-gram of "^host|path$", repeats included.

    The characters are one bound array: to cut n-grams from the text takes a walk from its start for each.
    """
    characters = F.array_remove(F.split(F.concat(F.lit("^"), host, F.lit("|"), path, F.lit("$")), ""), "")

    def of_size(held: Column, size: int) -> Column:
        # "^", "|" and "$" give three characters at least; sizes beyond the text yield nothing.
        last = F.size(held) - size + 1
        grams = F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.pmod(F.xxhash64(F.array_join(F.slice(held, i, F.lit(size)), "")), F.lit(buckets)).cast("int"))
        return F.when(last >= 1, grams).otherwise(F.array().cast("array<int>"))

    return F.get(F.transform(F.array(characters), lambda held: F.flatten(F.array(*(of_size(held, size) for size in sizes)))), 0)


def train(labelled: DataFrame, *, buckets: int = BUCKETS, rounds: int = 120, rate: float = 2.0, decay: float = 1e-3) -> tuple[list[float], float]:
    """(weights, bias) by gradient steps on mean n-gram frequencies. More than MAX_LABELLED rows are an error."""
    host, path = host_and_path(F.col("url"))
    rows = labelled.where("label is not null").select("label", ngram_buckets(host, path, buckets=buckets).alias("g")).orderBy("label", "g").limit(MAX_LABELLED + 1).collect()
    if len(rows) > MAX_LABELLED:
        raise ValueError(f"the labelled table may have {MAX_LABELLED} rows")
    weights, bias = [0.0] * buckets, 0.0
    for _ in range(rounds if rows else 0):
        step, top = {}, 0.0
        for row in rows:
            z = bias + sum(weights[g] for g in row.g) / math.sqrt(len(row.g))
            miss = (row.label - 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))) / len(rows)
            top += miss
            for g in row.g:
                step[g] = step.get(g, 0.0) + miss / math.sqrt(len(row.g))
        for g, s in step.items():
            weights[g] += rate * (s - decay * weights[g])
        bias += rate * top
    return weights, bias


def judge(pages: DataFrame, *, labelled: DataFrame | None = None, rules=RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict, block_score) for each row."""
    weights, bias = train(seed_table(pages.sparkSession) if labelled is None else labelled)
    host, path = host_and_path(F.col(url_col))
    out = pages.select(F.col(id_col), host.alias("host"), path.alias("path"))
    best = F.lit(None).cast("struct<size:int,rule:string,verdict:string>")
    for rule_host, rule_path, verdict in rules:
        fits = ((F.col("host") == rule_host) | F.endswith("host", F.lit("." + rule_host))) & F.startswith("path", F.lit(rule_path))
        name = rule_host + rule_path
        entry = F.struct(F.lit(len(name)).alias("size"), F.lit(name).alias("rule"), F.lit(verdict).alias("verdict"))
        best = F.greatest(best, F.when(fits, entry))
    grams = F.col("grams")
    table = F.array(*map(F.lit, weights))
    z = F.aggregate(grams, F.lit(0.0), lambda a, g: a + F.get(table, g)) / F.sqrt(F.size(grams)) + F.lit(bias)
    out = out.withColumn("best", best).withColumn("grams", ngram_buckets(F.col("host"), F.col("path"))).withColumn("block_score", 1 / (1 + F.exp(-z)))
    verdict = F.coalesce("best.verdict", F.when(F.col("block_score") >= 0.5, "block").otherwise("allow"))
    return out.select(id_col, "host", "path", F.col("best.rule").alias("rule"), verdict.alias("verdict"), "block_score")

"""A small labelled table of made-up URLs: what a filter should block, and ordinary ones that share their words' parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Hosts of sites to block: adult, gambling, pharmacy and replica spam, link farms, trackers, pirated files.
BLOCKED_HOSTS = """
adult-videos.example.com adultcams.example.net hot-adult.example.org free-adult-chat.example.com adult-dating.example.net
xxx-movies.example.org porn-tube.example.com sexcams-live.example.net casino-bonus.example.com online-casino.example.org
royalcasino.example.net casino-slots.example.com best-casino.example.com win-jackpot.example.org poker-win.example.com
win-money.example.net win-big.example.com sports-bets.example.com bets-online.example.org live-bets.example.net
betting-tips.example.com free-spins.example.com free-money.example.org free-gift-cards.example.net free-iphone.example.com
cheap-viagra.example.com cheap-meds.example.org cheap-watches.example.net cheap-replica.example.com cheap-followers.example.org
diet-pills.example.com pills-online.example.net buy-pills.example.org generic-pills.example.com spam-links.example.com
link-spam.example.org spamblog.example.net comment-spam.example.com link-farm.example.org content-farm.example.net
click-farm.example.com ads-server.example.com adserver.example.net popup-ads.example.org banner-ads.example.com
ads-network.example.net clicktrack.example.com track-pixel.example.org user-track.example.net tracker.example.com
email-track.example.com warez-download.example.org cracked-apps.example.com keygen-files.example.net payday-loans.example.com
quick-loans.example.org crypto-doubler.example.net get-rich-fast.example.com replica-bags.example.org hacked-accounts.example.com
""".split()

#: Hosts of ordinary sites; some hold words that sound like those above.
ALLOWED_HOSTS = """
news.example.com daily-herald.example.org thetimes.example.net theguild.example.com theatre.example.org thermal-lab.example.net
theory.example.com thesis-archive.example.org thething.example.net thenorth.example.com thisthat.example.org
library.example.org city-library.example.com museum.example.net national-gallery.example.org university.example.com
physics-dept.example.org cooking.example.com recipes-home.example.net gardening.example.org education.example.com
nation-builder.example.org station-radio.example.net action-films.example.com fashion-weekly.example.org
information.example.com translation.example.net publication.example.org table-tennis.example.com stable-homes.example.net
possible-worlds.example.org readable.example.com ocean-winds.example.org windows-help.example.com twinning.example.net
freedom-trail.example.org freelance-jobs.example.com better-homes.example.net alphabets.example.org farmhouse.example.com
farm-museum.example.org race-track.example.net soundtrack.example.com train-tracks.example.org headsup.example.net
threads.example.com adulthood-study.example.org caterpillars.example.net cheaper-travel.example.com hiking.example.org
health-service.example.com weather.example.net football.example.org opensource.example.com docs.example.net wiki.example.org
software-guide.example.com painting.example.net history.example.org bookshop.example.com music-school.example.net
astronomy.example.org nursing.example.com parliament.example.net energy.example.org insurance-law.example.com
teaching.example.org sailing.example.com running-club.example.net northern-rail.example.org southbank.example.com
thirteen.example.net father-and-son.example.org leather-craft.example.com together.example.org method.example.net
anthem.example.com cathedral.example.org mathematics.example.com athletics.example.net pottery.example.org
conservation.example.com tradition.example.net vegetable-garden.example.org capable-hands.example.com island.example.net
hand-made.example.org forest.example.com river.example.net reader.example.org butterflies.example.com thousand-lakes.example.org
white-whale.example.net when-where.example.com whisky-notes.example.org shipping.example.net sheep-and-wool.example.com
""".split()

PREFIXES = ("", "www.", "blog.", "m.")
PATHS = ("/en/{n}", "/fr/{n}/", "/de/{n}.html", "/es/{n}", "/", "", "/en/{n}/index.html", "/article/{n}")


def labelled_urls(spark: SparkSession) -> DataFrame:
    """(url, blocked): each host with two prefixes and paths, which follow from its place in its list."""
    rows = []
    for blocked, hosts in ((1, BLOCKED_HOSTS), (0, ALLOWED_HOSTS)):
        for i, host in enumerate(hosts):
            for k in (0, 1):
                path = PATHS[(i + 3 * k) % len(PATHS)].format(n=37 * i + 411 * k + 5)
                rows.append((f"https://{PREFIXES[(i + k) % len(PREFIXES)]}{host}{path}", blocked))
    return spark.createDataFrame(rows, "url string, blocked int")

"""The rule list of the URL filter: the contract's site rules, and hosts and paths that no corpus wants.

Each family of pattern rules is a list of words and one form; a rule is a word in
that form.  ``oracles.OP3`` states the same families by string functions.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

TOKEN = r"[a-z0-9]+"
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@dataclass(frozen=True)
class Rule:
    name: str
    verdict: str
    #: Searched for in ``host + path``.
    pattern: str
    #: Every match holds each of them as a whole token; ``a|b`` is either of two.
    tokens: tuple[str, ...]
    #: A site rule overrides pattern rules; the longest site rule wins.
    site: bool = False


def site_rule(name: str, verdict: str) -> Rule:
    """``host/path``: the host and its subdomains, paths that start with the rule's."""
    host, _, path = name.partition("/")
    path = "/" + path
    tokens = re.findall(TOKEN, host)
    inner = re.findall(TOKEN, path[: path.rfind("/") + 1].translate(_LOWER))
    return Rule(name, verdict, rf"^(?:[^/?#]*\.)?{re.escape(host)}{re.escape(path)}", tuple(dict.fromkeys(tokens + inner)), True)


def pattern_rule(name: str, pattern: str, *tokens: str) -> Rule:
    return Rule(name, "block", pattern, tokens)


#: The site rules of the contract.
SITES = [
    site_rule("com/en/", "block"),
    site_rule("example.com/en/7", "allow"),
    site_rule("net/de/", "allow"),
    site_rule("example.net/de/8", "block"),
    site_rule("org/es/", "block"),
]

#: A host with such a word between dots, dashes and other signs.
HOST_WORDS = {
    "gambling": "casino casinos poker roulette blackjack baccarat betting sportsbet bookmaker bookmakers slots jackpot lotto bingo sportsbook onlinecasino freespins wagering parlay",
    "adult": "porn porno pornos xxx sex sexcam sexcams camgirl camgirls escort escorts hentai milf nsfw erotik erotica nude nudes webcamsex sextube pornhd onlyfansleaks fetish",
    "piracy": "warez keygen keygens crackz serialz torrentz thepiratebay putlocker 123movies nulled crackedapk moddedapk freeroms romsmania",
    "pharmacy": "viagra cialis levitra tramadol xanax phentermine pharmacyrx rxonline cheapmeds steroidshop",
    "spam": "linkfarm adfly clickbank doorway spamdexing articlespinner backlinks buybacklinks seolinks replicawatches payday paydayloan paydayloans cashadvance",
    "scam": "doubler bitcoindoubler freebitcoin airdropclaim giveawaycrypto walletverify seedphrase giftcardgenerator fakeid",
}
#: A host that is two words with a dash: as one of its labels.
HOST_PAIRS = ("spam-farm", "link-farm", "free-bets", "cheap-pills", "free-casino", "online-casino", "free-slots", "adult-dating", "url-shortener", "free-proxy", "web-proxy", "essay-mill", "buy-followers", "get-rich", "cheap-meds", "hot-deals")
#: Whole domains at the top.
TOPS = ("xxx", "adult", "porn", "sex", "sexy", "cam", "bet", "casino", "poker", "bingo", "loan")
#: First labels of hosts that only serve adverts and counters.
SERVERS = ("ad", "ads", "adserver", "adservice", "adsystem", "adx", "banner", "banners", "click", "clicks", "counter", "pixel", "track", "tracker", "tracking", "telemetry", "beacon", "metrics")
#: A part of the path between slashes that holds no text of its own.
FOLDERS = {
    "shop": "cart checkout basket addtocart add-to-cart wishlist orderstatus compareproducts",
    "account": "logout signin signup register lostpassword resetpassword forgot-password my-account account-settings unsubscribe",
    "listing": "tag-cloud tagcloud calendar-archive search-results searchresults",
    "piracy": "warez keygen keygens cracks serials nulled torrents",
    "adult": "porn porno xxx hentai camgirls escorts nudes",
    "gambling": "casino casinos poker roulette slots betting sportsbook",
    "admin": "wp-admin wp-includes wp-json cgi-bin phpmyadmin administrator webmail cpanel autodiscover",
    "advert": "adserver adclick banner banners popunder clickthrough affiliates redirect",
}
#: Ends of paths.
FILES = ("wp-login.php", "xmlrpc.php", "wp-cron.php", "wp-signup.php", "login.php", "logout.php", "register.php", "captcha.php", "install.php", "phpinfo.php", "login.aspx", "default.aspx.bak", "print.php", "sendmessage.php", "memberlist.php", "ucp.php", "cart.php", "checkout.php", "basket.aspx", "robots.txt", "ads.txt", "sitemap.xml", "rss.xml", "feed.xml", "atom.xml")


def _tokens(words: str) -> list[str]:
    return re.findall(TOKEN, words)


def _patterns() -> list[Rule]:
    out = []
    inside = r"^[^/]*/(?:[^/]*/)*"
    for family, words in HOST_WORDS.items():
        out += [pattern_rule(f"{family} host: {w}", rf"^(?:[^/]*[^a-z0-9/])?{w}(?:[^a-z0-9]|\Z)", w) for w in words.split()]
    out += [pattern_rule(f"host label: {w}", rf"^(?:[^/:]*\.)?{w}(?:[./:]|\Z)", *_tokens(w)) for w in HOST_PAIRS]
    out += [pattern_rule(f"top domain: {w}", rf"^[^/:]*\.{w}(?:[:/]|\Z)", w) for w in TOPS]
    out += [pattern_rule(f"server: {w}", rf"^{w}\.", w) for w in SERVERS]
    for family, words in FOLDERS.items():
        out += [pattern_rule(f"{family} folder: {w}", rf"{inside}{w}(?:/|\Z)", *_tokens(w)) for w in words.split()]
    out += [pattern_rule(f"file: {w}", rf"{inside}{re.escape(w)}\Z", *_tokens(w)) for w in FILES]
    out.append(pattern_rule("phishing login", r"^(?:[^/]*[^a-z0-9/])?(?:secure|verify)-[^/]*/(?:[^/]*/)*login/verify", "login", "secure|verify"))
    out.append(pattern_rule("numeric host", rf"^(?=[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+/){inside}(?:admin|login|setup)(?:/|\Z)", "admin|login|setup"))
    return out


PATTERNS = _patterns()

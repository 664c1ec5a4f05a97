"""Verdicts on web addresses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Results depend on these lists and the pattern being as they are.
#: Site labels whose pages carry no running text or nothing fit for training.
SITES = (
    "500px", "aapks", "akamaihd", "amazon", "apple", "artifactfire", "artstation", "awwni", "bandcamp", "battleforthenet", "coinscalendar",
    "dailymotion", "deviantart", "discord", "discordapp", "dlapkandroid", "dropbox", "e621", "ebay", "edealinfo", "erome", "eroshare", "explosm",
    "facebook", "fbcdn", "flickr", "furaffinity", "futhead", "gatopardo", "gfycat", "gifsound", "gifsoup", "giphy", "github", "google", "gunprime",
    "gyazo", "horsefucker", "hotdealstar", "imagefap", "imageshack", "imgflip", "imgur", "instagram", "karmadecay", "kryptocal", "kym-cdn",
    "liveleak", "livememe", "lmgtfy", "magaimg", "memegenerator", "minorplanetcenter", "minus", "mobafire", "morejpeg", "nocookie", "pcpartpicker",
    "photobucket", "pinimg", "pinterest", "pixiv", "pornhub", "prntscr", "puu", "qkme", "quickmeme", "radd", "redd", "reddit", "reddit-stream",
    "redditlog", "redditmedia", "reddituploads", "redtube", "reupp", "reverb", "roanoke", "rollingstone", "sli", "soundcloud", "soundgasm",
    "spankbang", "spotify", "strawpoll", "streamable", "timeanddate", "tinypic", "touhouradio", "tumblr", "twimg", "twitch", "twitter", "vid",
    "vimeo", "vine", "vkaao", "vocaroo", "voyagefusion", "walmart", "wciu", "wikimedia", "wikipedia", "xhamster", "xkcd", "xvideos", "youtu",
    "youtube", "youtubedoubler", "ytimg", "zillexplorer",
)
#: File endings of media, archives, programs and data.
ENDINGS = (
    ".3gp", ".7z", ".ai", ".aif", ".apk", ".app", ".avi", ".bin", ".bmp", ".bz2", ".css", ".csv", ".dat", ".deb", ".dmg", ".doc", ".docx", ".exe",
    ".gif", ".gifv", ".gz", ".iso", ".jar", ".jpeg", ".jpg", ".js", ".log", ".mid", ".midi", ".mkv", ".mov", ".mp3", ".mp4", ".mpeg", ".mpg", ".ogg",
    ".ogv", ".otf", ".pdf", ".pkg", ".png", ".pps", ".ppt", ".pptx", ".psd", ".py", ".qt", ".ram", ".rar", ".sql", ".svg", ".swf", ".tar.gz", ".tar",
    ".tgz", ".tiff", ".ttf", ".txt", ".wav", ".webm", ".wma", ".wmv", ".xls", ".xlsx", ".xml", ".xz", ".zip",
)
#: Second-level labels that, under a country's two letters, are part of the public suffix (amazon.co.uk).
SECOND_LEVEL = ("ac", "asn", "co", "com", "edu", "firm", "gen", "go", "gob", "gouv", "gov", "gub", "gv", "id", "info", "ltd", "me", "mil", "ne", "net", "nhs", "nic", "nom", "or", "org", "plc", "police", "res", "sch", "web")
#: Addresses of at most so many characters are no addresses.
SHORT = 8
#: An address with a host name or four numbers, a port, and a path or query without white space.
WELL_FORMED = r"(?i)^https?://(([A-Z0-9]([A-Z0-9-]{0,61}[A-Z0-9])?\.)+([A-Z]{2,6}\.?|[A-Z0-9-]{2,}\.?)|\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})(:\d+)?(/?|[/?]\S+)$"


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z]+://([^/:?#]*)", 1))


def site_label(url: Column) -> Column:
    """The registered label of the host: the one before its public suffix; the host itself where it is an address of numbers or has one label."""
    parts = F.split(F.rtrim(host(url), F.lit(".")), r"\.")
    n = F.size(parts)
    country = (n > 2) & (F.length(F.element_at(parts, -1)) == 2) & F.get(parts, n - 2).isin(*SECOND_LEVEL)
    return F.when(host(url).rlike(r"^[0-9.]+$") | (n < 2), host(url)).when(country, F.get(parts, n - 3)).otherwise(F.get(parts, n - 2))


def blocked_site(url: Column) -> Column:
    return site_label(url).isin(*SITES)


def blocked_ending(url: Column) -> Column:
    return F.lower(F.element_at(F.split(url, r"\?"), 1)).rlike("(" + "|".join(x.replace(".", r"\.") for x in ENDINGS) + ")$")


def short(url: Column) -> Column:
    return F.length(url) <= SHORT


def malformed(url: Column) -> Column:
    return ~url.rlike(WELL_FORMED)


def verdict(url: Column, nth: Column) -> Column:
    """The first rule that an address breaks; ``nth``: its number among equal ones."""
    return F.when(blocked_site(url), "domain").when(blocked_ending(url), "extension").when(short(url), "short").when(malformed(url), "malformed").when(nth > 1, "duplicate").otherwise("ok")

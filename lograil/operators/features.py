"""Request features: 21 numbers in fixed order, one select."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Keywords, whole and in the order of the contract.
SENSITIVE = [
    ".env", ".git", "phpunit", "admin", "config", ".htaccess", ".htpasswd", "robots.txt", "sitemap.xml", "crossdomain.xml", "clientaccesspolicy.xml", "phpinfo", "phpmyadmin", "wp-admin", "wp-config",
    "wp-content", "wp-includes", "xmlrpc.php", "admin.php", "login.php", "register.php", "install.php", "setup.php", "api", "swagger", "actuator", "health", "metrics", "trace", "dump", "env", "heapdump",
    "threaddump", "logfile", "jolokia", "api-docs", "v2/api-docs", "swagger-ui", "swagger-resources", "webjars", "console", "management", "debug", "test", "backup", "bak", "old", "zip", "tar.gz", "sql",
    "dump", "db", "database",
]
COMMANDS = [
    ";", "|", "&", "&&", "||", "`", "$(", "cmd.exe", "powershell.exe", "bash", "sh", "zsh", "ksh", "ls", "dir", "cat", "type", "echo", "whoami", "id", "pwd", "cd", "rm", "del", "mv", "cp", "mkdir", "md",
    "rmdir", "rd", "chmod", "chown", "ping", "nslookup", "dig", "wget", "curl", "wget", "nc", "netcat", "telnet",
]
SQL = [
    "SELECT", "INSERT", "UPDATE", "DELETE", "DROP", "ALTER", "CREATE", "TRUNCATE", "JOIN", "WHERE", "FROM", "ORDER", "GROUP", "HAVING", "UNION", "LIKE", "IN", "BETWEEN", "AND", "OR", "NOT", "EXEC", "EXECUTE",
    "SP_", "xp_", "sys.", "information_schema", "pg_catalog", "mysql.", "sqlite_", "oracle.",
]
BOTS = [
    "zgrab", "censys", "scanner", "bot", "crawl", "spider", "nmap", "masscan", "wappalyzer", "wpscan", "dirb", "gobuster", "ffuf", "sqlmap", "nikto", "hydra", "metasploit", "burp", "zap", "acunetix",
    "netsparker", "appscan", "ibm", "tenable", "qualys", "rapid7", "openvas", "nessus", "Nexpose", "DDoS", "slowloris", "LOIC", "HOIC", "UFONet", "Tor", "proxy", "scrapy", "beautifulsoup", "mechanize",
    "selenium", "phantomjs", "curl", "wget", "libwww", "python-requests", "python-urllib", "java/", "go-http-client", "httpie", "postman", "insomnia", " Paw/", "Apache-HttpClient", "okhttp", "axios",
    "node-fetch", "got", "undici", "aiohttp", "httpx", "cloudsniffer", "Go-http-client", "Go http client", "UniversalFeedParser", "FeedFetcher", "FeedBurner", "bloglines", "GreatNews", "Netvibes",
    "Newsgator", "NewsBlur", "Feedly", "Pulse", "Flipboard", "Tiny Tiny RSS", "Superfeedr", "Pubsubhubbub", "GoogleProducer", "Mediapartners-Google", "AdsBot-Google", "Googlebot", "Googlebot-Image",
    "Googlebot-News", "Googlebot-Video", "Googlebot-Mobile", "Mediapartners-Google", "Bingbot", "Slurp", "Yahoo! Slurp", "Yahoo! Slurp China", "Yahoo! Slurp India", "Baiduspider", "Baiduspider-image",
    "Baiduspider-video", "Baiduspider-favo", "Baiduspider-cpro", "Baiduspider-ads", "Sogou", "Sogou Orion spider", "Sogou web spider", "Exabot", "Facebot", "Twitterbot", "Applebot", "DuckDuckBot",
    "YandexBot", "YandexImages", "YandexVideo", "YandexMedia", "YandexBlogs", "YandexFavicons", "YandexMetrika", "Yandex珈百璃", "Qwant", "Qwantify", "MusicianMatch", "ICC-Crawler", " archive.org_bot",
    "aiHitBot", "alexa", "ia_archiver", "Ask Jeeves/Teoma", "KrOWLer", "GarlikCrawler", "Nutch", "Heritrix", "htdig", "WebAlta", "larbin", "久而久之访问", "SeznamBot", "Uptimebot", "UptimeRobot",
]

NAMES = [
    "method_is_get", "method_is_post", "uri_length", "uri_depth", "has_query", "query_length", "special_char_count", "digit_ratio", "url_encoded_count", "has_double_encoding", "path_traversal_count",
    "has_sensitive_file", "has_cmd_keyword", "has_sql_keyword", "is_binary_request", "status_code", "is_4xx", "is_5xx", "user_agent_length", "is_empty_user_agent", "is_bot_user_agent",
]


def effective(words: list[str], fold: Callable[[str], str] = str.lower) -> list[str]:
    """The words that can match a text in that case, without those that contain another one, each once."""
    able = list(dict.fromkeys(w for w in words if fold(w) == w))
    return [w for w in able if not any(o != w and o in w for o in able)]


def any_of(words: list[str], fold: Callable[[str], str] = str.lower) -> str:
    """An alternation of the words as escaped literals, for texts in the given case."""
    return "|".join(re.sub(r"([^\w\s])", r"\\\1", w) for w in effective(words, fold))


def occurrences(text: Column, word: str) -> Column:
    """Non-overlapping occurrences of a literal."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(word), F.lit("")))) / len(word)).cast("int")


def feature_columns(method: Column, uri: Column, status: Column, agent: Column) -> dict[str, Column]:
    """Features by name; null texts count as empty, a bad status as 0."""
    m, u, a = F.upper(F.coalesce(method, F.lit(""))), F.coalesce(uri, F.lit("")), F.coalesce(agent, F.lit(""))
    low, code = F.lower(u), F.coalesce(status.cast("string").try_cast("int"), F.lit(0))
    at = F.instr(u, "?")
    flag = lambda c: c.cast("int")
    cols = [
        flag(m == "GET"), flag(m == "POST"), F.length(u), occurrences(u, "/"), flag(at > 0), F.when(at > 0, F.length(u) - at).otherwise(0),
        F.regexp_count(u, F.lit(r"[<>!@#$%^&*()\[\]{}|;:,./?]")), F.when(F.length(u) > 0, F.regexp_count(u, F.lit("[0-9]")) / F.length(u)).otherwise(F.lit(0.0)),
        F.regexp_count(u, F.lit("%[0-9A-Fa-f]{2}")), flag(F.contains(u, F.lit("%25"))), occurrences(low, "../") + occurrences(low, "%2e%2e/") + occurrences(low, "%2e%2e%2f"),
        flag(low.rlike(any_of(SENSITIVE))), flag(low.rlike(any_of(COMMANDS))), flag(F.upper(u).rlike(any_of(SQL, str.upper))), flag(u.rlike(r"\\x[0-9A-Fa-f]{2}")),
        code, flag(code.between(400, 499)), flag(code.between(500, 599)), F.length(a), flag(a == ""), flag(F.lower(a).rlike(any_of(BOTS))),
    ]
    return dict(zip(NAMES, cols, strict=True))


def extract(logs: DataFrame, keep: tuple[str, ...] = (), method: str = "method", uri: str = "path", status: str = "status", agent: str = "user_agent") -> DataFrame:
    """The kept columns and the 21 features."""
    cols = feature_columns(F.col(method), F.col(uri), F.col(status), F.col(agent))
    return logs.select(*keep, *[c.alias(n) for n, c in cols.items()])


def align(features: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Features in fixed order as doubles: missing ones are 0, others go."""
    return features.select(*keep, *[(F.coalesce(F.col(n).cast("double"), F.lit(0.0)) if n in features.columns else F.lit(0.0)).alias(n) for n in NAMES])


def labelled(rows: DataFrame, label: str = "Class") -> DataFrame:
    """Features of labelled requests (status 200); labels other than Valid, Anomaly and Anomalous go. label_int: 0 or 1."""
    number = F.when(F.col(label) == "Valid", 0).when(F.col(label).isin("Anomaly", "Anomalous"), 1)
    kept = rows.withColumns({"label_int": number, "_s": F.lit(200)}).where("label_int is not null")
    return extract(kept, keep=("label_int",), status="_s")

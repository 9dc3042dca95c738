"""DOIs, titles, record keys and the hash buckets derived from them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sievelake.functions import fixed_values as fixed
from sievelake.functions.text import ordered_label, strip


def norm_doi(c: Column) -> Column:
    lowered = F.lower(strip(c))
    bare = F.regexp_replace(lowered, r"^(?:https?://)?(?:dx\.)?doi\.org/", "")
    return F.regexp_replace(bare, r"^doi:\s*", "")


def extract_doi(c: Column) -> Column:
    """A DOI out of a DOI-or-URL cell; '' when there is none."""
    raw = strip(c)
    found = F.regexp_extract(raw, r"(?U)(10\.\d{4,9}/\S+)", 1)
    return F.when(raw.startswith("10."), raw).otherwise(found)


def norm_title(c: Column) -> Column:
    lowered = F.lower(F.coalesce(c, F.lit("")))
    return F.trim(F.regexp_replace(lowered, "[^a-z0-9]+", " "))


def compact_title(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", "")


def title_terms(c: Column, stopwords: list[str] = fixed.TITLE_STOPWORDS) -> Column:
    """Content words of a title, in order, repeats kept."""
    words = F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"([a-z][a-z\-]{2,})"), 1)
    return F.filter(words, lambda w: ~w.isin(*stopwords))


def record_key(doi: Column, title: Column) -> Column:
    clean = norm_doi(doi)
    return F.when(clean != "", clean).otherwise(F.concat(F.lit("T:"), norm_title(title)))


def record_id(key: Column) -> Column:
    return F.concat(F.lit("R"), F.substring(F.md5(key), 1, 9))


def md5_modulo(text: Column, n: int) -> Column:
    """The MD5 of `text`, read as one 128-bit number, modulo `n` (n below 2^31).

    Horner's rule over four 32-bit words keeps every step inside a 64-bit integer.
    """
    digest = F.md5(text)
    rest = F.lit(0).cast("bigint")
    for word in range(4):
        value = F.conv(F.substring(digest, 1 + 8 * word, 8), 16, 10).cast("bigint")
        rest = (rest * F.lit((1 << 32) % n).cast("bigint") + value) % F.lit(n).cast("bigint")
    return rest


def block_of(key: Column, blocks: int = 3) -> Column:
    return md5_modulo(key, blocks)


def is_calibration(key: Column, percent: int = fixed.CALIBRATION_PERCENT) -> Column:
    """In the calibration set; the sets of rising percentages are nested."""
    return md5_modulo(F.concat(F.lit("cal:"), key), 100) < percent


def second_reviewer(key: Column, reviewers: list[str] = fixed.SECOND_REVIEWERS) -> Column:
    place = md5_modulo(F.concat(F.lit("2nd:"), key), len(reviewers))
    return F.element_at(F.array(*[F.lit(r) for r in reviewers]), (place + 1).cast("int"))


def doi_prefix_label(doi: Column, labels: dict[str, str], otherwise: str) -> Column:
    prefix = F.substring_index(doi, "/", 1)
    return ordered_label(*[(prefix == p, v) for p, v in labels.items()], otherwise=otherwise)


def provider_of_doi(doi: Column) -> Column:
    return doi_prefix_label(doi, fixed.DOI_PROVIDERS, "other")


def publisher_of_doi(doi: Column) -> Column:
    label = doi_prefix_label(doi, fixed.DOI_PUBLISHERS, fixed.OTHER_PUBLISHER)
    return F.when(F.coalesce(doi, F.lit("")) == "", fixed.NO_DOI_GROUP).otherwise(label)


def guess_source(url: Column, doi: Column, publisher: Column | None = None) -> Column:
    """The database a record came from, judged by URL, DOI prefix and, if given, publisher.

    With a publisher column the rules are the wider ones of the source report.
    """
    u = F.lower(F.coalesce(url, F.lit("")))
    d = F.lower(F.coalesce(doi, F.lit("")))
    elsevier = u.contains("scopus.com") | u.contains("sciencedirect.com") | d.startswith("10.1016")
    pubmed = u.contains("pubmed.ncbi.nlm.nih.gov") | d.startswith("10.1037")
    otherwise = "Others/Unknown"
    if publisher is not None:
        p = F.lower(F.coalesce(publisher, F.lit("")))
        elsevier = elsevier | p.contains("elsevier") | p.contains("springer")
        pubmed = pubmed | u.contains("apa.org") | u.contains("ncbi.nlm.nih.gov")
        otherwise = "Others/不明"
    return ordered_label(
        (u.contains("dl.acm.org") | d.startswith("10.1145"), "ACM"),
        (u.contains("ieeexplore.ieee.org") | d.startswith("10.1109"), "IEEE"),
        (elsevier, "Scopus/Elsevier"),
        (pubmed, "PubMed/PsycInfo"),
        otherwise=otherwise,
    )


def url_domain(url: Column) -> Column:
    """Host of a URL; the first 40 characters of anything else, a mark when blank."""
    u = F.coalesce(url, F.lit(""))
    host = F.regexp_extract(u, r"https?://([^/]+)", 1)
    return F.when(host != "", host).when(u == "", "(URL無し)").otherwise(F.substring(u, 1, 40))


def doi_head(doi: Column) -> Column:
    """First seven characters of a DOI, a mark when blank."""
    d = F.coalesce(doi, F.lit(""))
    return F.when(d == "", "(DOI無し)").otherwise(F.substring(d, 1, 7))


def best_link(open_url: Column, doi: Column, title: Column) -> Column:
    """An open-access URL, else the DOI's URL, else a title search."""
    oa, d = F.coalesce(open_url, F.lit("")), F.coalesce(doi, F.lit(""))
    search = F.regexp_replace(F.url_encode(F.coalesce(title, F.lit(""))), r"\+", "%20")
    # `url_encode` is form encoding: it also escapes "/" and "~", and leaves "*" alone.
    search = F.regexp_replace(F.regexp_replace(F.regexp_replace(search, "%2F", "/"), "%7E", "~"), r"\*", "%2A")
    return (
        F.when(oa.startswith("http"), oa)
        .when(d != "", F.concat(F.lit("https://doi.org/"), d))
        .otherwise(F.concat(F.lit("https://scholar.google.com/scholar?q="), search))
    )

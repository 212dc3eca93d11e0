"""Text extraction and classification as column expressions.

All patterns are evaluated inside the JVM (rules on places in a text are in `spans`); a text that doesn't match gives null, and a null text
is an empty one where a rule asks whether something occurs in it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P
from . import spans


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def _extract(c: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def capacity(text: Column) -> Column:
    """Megawatts of the first figure with a unit; gigawatts count a thousandfold. Thousands separators
    are not understood, and a unit may go on (MWh)."""
    pattern = rf"(?i)(\d+(?:\.\d+)?){P.SPACE}*(mw|gw|megawatt|gigawatt)"
    value, unit = _extract(text, pattern, 1).cast("double"), F.lower(F.regexp_extract(text, pattern, 2))
    return F.when(unit.startswith("g"), value * 1000).otherwise(value)


def megawatts(text: Column) -> Column:
    """Megawatts of the first figure in MW, thousands separators understood, gigawatts not."""
    return F.regexp_replace(_extract(text, rf"(?i)(\d[\d,]*(?:\.\d+)?){P.SPACE}*(?:MW|megawatt)"), ",", "").cast("double")


def has_any(text: Column, literals: tuple[str, ...]) -> Column:
    """Whether any literal occurs, in any case."""
    return F.lower(_text(text)).rlike(P.any_of(literals))


def is_early_stage(text: Column) -> Column:
    return ~has_any(text, P.EXCLUDE) & has_any(text, P.EARLY_STAGE)


def mentions_solar(text: Column) -> Column:
    low = F.lower(_text(text))
    return low.contains("solar") | low.contains("photovoltaic") | low.contains(" pv ")


def has_solar_component(name: Column, description: Column | None = None) -> Column:
    both = F.concat_ws(" ", _text(name), _text(description) if description is not None else F.lit(""))
    return both.rlike("(?i)" + P.whole_word("solar|photovoltaic|pv"))


def is_wind(name: Column, description: Column | None = None) -> Column:
    by_name = _text(name).rlike("(?i)wind(?![A-Za-z0-9_])")
    return by_name if description is None else by_name | F.lower(_text(description)).contains("turbine")


def is_noisy_name(name: Column, require_shape: bool = False) -> Column:
    """Names of articles, reports and slogans rather than of projects."""
    noise = "(?i)" + "|".join(P.NOISY_NAMES) + "|" + P.whole_word(P.FOREIGN_PLACES)
    noisy = (F.length(F.trim(_text(name))) <= 3) | _text(name).rlike(noise)
    return noisy | ~_text(name).rlike("(?i)" + P.whole_word(P.PROJECT_SHAPE)) if require_shape else noisy


def location(text: Column, country: str = "AU") -> Column:
    """The first place of the country's list, in the list's order, that occurs in the text."""
    places = F.array(*(F.lit(x) for x in P.LOCATIONS[country]))
    return F.get(F.filter(places, lambda x: _text(text).contains(x)), F.lit(0))


def status(text: Column, phrases: tuple[str, ...] = P.UNDER_DEVELOPMENT) -> Column:
    return F.when(has_any(text, phrases), "under_development").otherwise("announced")


def developer(text: Column) -> Column:
    """A capitalised name after "by" or the like, else one that ends in a company word; 4 to 59 long."""
    ends = "Energy|Solar|Power|Renewables|Green|Clean|Capital|Group|Ltd|Pty"
    first = rf"(?:by|developer?|developed by|from)\s+([A-Z][A-Za-z\s&]+(?:{ends}|Inc|Corp|Co\.|Company)?)"
    second = rf"([A-Z][A-Za-z\s&]+(?:{ends}))"
    found = [F.trim(_extract(text, p)) for p in (first, second)]
    return F.coalesce(*(F.when(F.length(x).between(4, 59), x) for x in found))


def technology_flags(name: Column, description: Column) -> dict[str, Column]:
    """Whether each kind of technology is mentioned. Projected first, each pattern runs once a row."""
    both = F.concat_ws(" ", _text(name), _text(description))
    return {k: both.rlike("(?i)" + P.whole_word(v)) for k, v in P.TECHNOLOGY.items()}


def technology(name: Column, description: Column) -> dict[str, Column]:
    """technology_type, relevance_status, is_solar and is_renewable of a referral."""
    return technology_of(technology_flags(name, description))


def technology_of(has: dict[str, Column]) -> dict[str, Column]:
    """The same, from flags."""
    cases = [
        (has["solar"] & has["bess"], "Solar + BESS", "solar"), (has["solar"], "Solar", "solar"),
        (has["wind"] & has["bess"], "Wind + BESS", "wind"), (has["wind"], "Wind", "wind"), (has["bess"], "BESS", "bess"),
        (has["transmission"], "Transmission", "transmission"), (has["renewable"], "Renewable (unclassified)", "needs_review"),
    ]
    kind, relevance = F.lit("Unknown"), F.lit("needs_review")
    for condition, k, r in reversed(cases):
        kind, relevance = F.when(condition, k).otherwise(kind), F.when(condition, r).otherwise(relevance)
    return {"technology_type": kind, "relevance_status": relevance, "is_solar": has["solar"], "is_renewable": has["renewable"]}


def is_approved(project_status: Column, decision_status: Column, strict: bool = False) -> Column:
    """Whether an approval phrase occurs in either status. By that rule "not approved" counts as
    approved; `strict` lets a rejection phrase win."""
    both = F.concat_ws(" ", _text(project_status), _text(decision_status))
    return has_any(both, P.APPROVED) & ~has_any(both, P.REJECTED) if strict else has_any(both, P.APPROVED)


def strip_html(html: Column) -> Column:
    """Whole text of HTML: scripts, styles and tags go, white space collapses."""
    text = F.regexp_replace(html, r"(?is)<script.*?</script>|<style.*?</style>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(text, "<[^>]+>", " "), r"\s+", " "))


def emails(html: Column) -> Column:
    """All addresses in the text of HTML, lower-cased, in order."""
    found = F.regexp_extract_all(strip_html(html), F.lit(r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}"), F.lit(0))
    return F.transform(found, F.lower)


def email_contexts(html: Column, around: int = 200) -> Column:
    """Each address in the text of HTML, lower-cased, with its place and the text up to `around` characters before
    and after it."""
    return spans.email_contexts(strip_html(html), around)


def person_name(context: Column) -> Column:
    """The first pair of capitalised words that isn't a known phrase."""
    pairs = F.regexp_extract_all(context, F.lit(r"(?<![A-Za-z0-9_])([A-Z][a-z]{1,20}\s+[A-Z][a-z]{1,25})(?![A-Za-z0-9_])"), F.lit(1))
    clean = F.transform(pairs, lambda x: F.regexp_replace(x, r"\s+", " "))
    return F.get(F.filter(clean, lambda x: ~x.rlike(rf"(?i)^(?:{P.NOT_A_PERSON})\z")), F.lit(0))


def phone(context: Column) -> Column:
    pattern = r"(\(?\+?\d{1,4}[\s\-.]?\(?\d{2,4}\)?[\s\-.]?\d{3,4}[\s\-.]?\d{3,4})"
    return F.trim(F.regexp_replace(_extract(context, pattern), r"\s+", " "))


def email_domain(email: Column) -> Column:
    return F.lower(F.coalesce(F.get(F.split(email, "@"), F.lit(1)), F.lit("")))


def email_related(email: Column, company: Column) -> Column:
    """Whether an address's domain plausibly belongs to a company: by a word, the whole name, the
    name's beginning, a shared run of four letters, or the acronym."""
    domain, low = email_domain(email), F.lower(_text(company))
    words = F.filter(F.split(F.regexp_replace(low, "[^a-z0-9]", " "), r"\s+"), lambda w: w != "")
    rare = F.filter(words, lambda w: (F.length(w) >= 2) & ~w.isin(*P.COMMON_COMPANY_WORDS))
    slug = F.regexp_replace(low, "[^a-z0-9]", "")
    root = F.regexp_replace(F.regexp_replace(domain, r"\.[^.]+\z", ""), "[^a-z0-9]", "")

    def grams(w: Column) -> Column:
        return F.when(F.length(w) >= 4, F.transform(F.sequence(F.lit(1), F.length(w) - 3), lambda i: F.substr(w, i, F.lit(4)))).otherwise(F.array().cast("array<string>"))

    acronym = F.array_join(F.transform(words, lambda w: F.left(w, F.lit(1))), "")
    return F.coalesce(
        (_text(company) != "") & (
            F.exists(rare, lambda w: domain.contains(w))
            | ((F.length(slug) >= 3) & domain.contains(slug))
            | ((F.length(root) >= 3) & slug.contains(root))
            | F.arrays_overlap(F.flatten(F.transform(F.filter(rare, lambda w: F.length(w) >= 4), grams)), grams(root))
            | ((F.length(acronym) >= 2) & domain.contains(acronym))
        ), F.lit(False),
    )


def valid_project_contact(email: Column, company: Column) -> Column:
    """A personal address at a domain of the company, no free mail or authority."""
    domain = email_domain(email)
    invalid = domain.rlike(f"(?:{P.any_of(P.INVALID_DOMAINS)})\\z")
    personal = ~email.rlike(f"(?i)^(?:{P.GENERIC_MAILBOX})@") & email.contains("@")
    return F.coalesce((email != "") & ~invalid & personal & email_related(email, company), F.lit(False))


def contact_key(name: Column) -> Column:
    """An organisation's name without company words, for matching."""
    low = F.regexp_replace(F.lower(name), P.whole_word(P.CONTACT_STOP_WORDS), "")
    return F.trim(F.regexp_replace(F.regexp_replace(low, "[^a-z0-9]", " "), r"\s+", " "))


def company_key(name: Column) -> Column:
    """A company's name without its suffixes, taken off one after another, and without marks."""
    low = F.lower(_text(name))
    for suffix in P.COMPANY_SUFFIXES:
        low = F.regexp_replace(low, rf"\s+{suffix}\s*\z", "")
    return F.regexp_replace(low, "[^a-z0-9]", "")


def title_score(title: Column) -> Column:
    score = F.lit(1)
    for pattern, value in reversed(P.TITLE_SCORES):
        score = F.when(title.rlike("(?i)" + pattern), value).otherwise(score)
    return score


def serial_date(serial: Column) -> Column:
    """The date of a spreadsheet's day number."""
    return F.date_add(F.lit("1899-12-30").cast("date"), F.floor(serial).cast("int"))


def long_date(text: Column) -> Column:
    """yyyy-Month-d, or "d Month yyyy"; null if neither."""
    return F.when(text.contains("-"), F.try_to_date(text, "yyyy-MMMM-d")).otherwise(F.try_to_date(text, "d MMMM yyyy"))


def referral_date(text: Column) -> Column:
    """A referral's date: a day number, an ISO date, or month/day/year. What cannot be read is null
    rather than an error; count the nulls to see rejects."""
    serial = F.when(text.rlike(r"^\d+(\.\d+)?\z"), serial_date(text.try_cast("double")))
    return F.coalesce(serial, F.try_to_date(F.left(text, F.lit(10)), "yyyy-MM-dd"), F.try_to_date(text, "M/d/yyyy"))


def jurisdiction_country(jurisdiction: Column) -> Column:
    return F.when(F.lower(_text(jurisdiction)) == "new zealand", "NZ").otherwise("AU")


def host(url: Column) -> Column:
    return F.regexp_replace(F.try_parse_url(url, F.lit("HOST")), r"^www\.", "")


def developer_domain(url: Column, skip: tuple[str, ...] = ()) -> Column:
    """A URL's host, unless it is a news, authority or social site."""
    own = host(url)
    allowed = ~own.isin(*P.NON_DEVELOPER_HOSTS)
    for part in skip:
        allowed &= ~url.contains(part)
    return F.when(allowed, own)


def csv_field(value: Column) -> Column:
    """A field of a CSV line: quoted where it holds a comma, a quote or a line feed; null is empty."""
    text = _text(value.cast("string"))
    return F.when(text.rlike('[,"\\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def url_component(text: Column) -> Column:
    """Percent-encoding as URL components have it: space is %20, and !'()* stay."""
    out = F.replace(F.url_encode(text), F.lit("+"), F.lit("%20"))
    for code, mark in (("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")")):
        out = F.replace(out, F.lit(code), F.lit(mark))
    return out


def is_rate_limited(message: Column) -> Column:
    return _text(message).rlike("429|RATELIMIT_EXCEEDED") | F.lower(_text(message)).rlike("quota|rate limit")


def json_array(text: Column) -> Column:
    """The JSON array inside a model's answer: fences go, then from the first [ to the last ]."""
    return _extract(F.regexp_replace(text, "```(?:json)?", ""), r"(\[[\s\S]*\])")

"""Word lists and patterns."""

# Right results need exactly these lists.

EARLY_STAGE = (
    "announced", "proposed", "proposes", "proposal", "plans to build",
    "new project", "new solar", "new bess", "new battery",
    "planning approval", "resource consent", "development approval", "da approved",
    "approved", "approval", "receives approval", "gets approval", "granted",
    "permit", "permits", "consent", "consented", "planning permit", "planning consent",
    "application", "applies", "applied", "lodged", "lodges",
    "referral", "referred", "da lodged", "eis lodged",
    "environmental impact", "eis", "epbc referral",
    "under development", "under construction", "in development",
    "planning", "feasibility", "pre-development", "early stage",
    "to build", "will build", "breaking ground", "scoping",
    "commits", "committed", "invest", "investment", "selected",
    "awarded", "awarded contract", "reaches financial close", "financial close", "reaches fc",
    "commences", "commence", "begins construction", "begin construction",
    "construction begins", "construction commences", "starts construction",
    "breaks ground", "groundbreaking",
)

EXCLUDE = (
    "fully operational", "now generating", "commissioned", "now online", "now operating", "energised",
    "energized", "connected to grid", "switched on", "now generating power",
)

LOCATIONS = {
    "AU": (
        "NSW", "VIC", "QLD", "SA", "WA", "TAS", "NT", "ACT", "New South Wales", "Victoria", "Queensland",
        "South Australia", "Western Australia", "Tasmania", "Northern Territory",
    ),
    "NZ": (
        "Auckland", "Wellington", "Canterbury", "Otago", "Waikato", "Bay of Plenty", "Manawatu", "Hawke's Bay",
        "Marlborough", "Northland", "Southland",
    ),
}

UNDER_DEVELOPMENT = ("under development", "under construction", "development approval", "planning approval", "resource consent")

REFERRAL_UNDER_DEVELOPMENT = (
    "under assessment", "guidelines issued", "assessment approach determined", "assessment commenced", "considering variation",
    "approval decision", "condition variation", "final preliminary", "considering final decision",
)

SKIPPED_STATUSES = ("Project Withdrawn", "Clearly Unacceptable", "Project Lapsed")

APPROVED = (
    "approval given", "approved", "decision made", "project approved", "approval decision made", "approval in force",
    "conditions of approval varied", "variation to approval given",
)

REJECTED = (
    "withdrawn", "project withdrawn", "clearly unacceptable", "lapsed", "project lapsed", "expired", "refused",
    "not approved", "approval refused",
)

#: Words of referral texts; whole words unless a pattern says more.
TECHNOLOGY = {
    "solar": "solar|photovoltaic|pv",
    "bess": "bess|battery|batteries|storage",
    "wind": r"wind\s*farm|wind\s*turbine|wind\s*energy|wind\s*power",
    "transmission": r"transmission|substation|interconnector|powerline|power\s*line",
    "renewable": "solar|photovoltaic|pv|wind|bess|battery|hydro|geothermal|renewable",
}

NOISY_NAMES = (
    "officially opened", "full.?operations?", "reaches? full", "milestone reached", "huge milestone", "already operational",
    "recommended for approval", "approved by.*planning", "commission approves?", "modification application", "amendment report",
    "thank you for your feedback", "public views? about", "public consultation",
    "sign(?:s|ed)? (?:a )?ppa", "power purchase agreement", "board visit", "ayala corporation", "joins? circular",
    "circular pv alliance", "industry member", "circular future", "solar panels? to be recycled",
    "help(?:s|ed)? (?:get|fund|secure|raise|deliver)", "helps? (?:the|a|an) ", "and .{3,30} help",
    "to power (?:uts|unis?|university|school|hospital|council|government|municipality)", "to underpin", "backs? circular",
    "folds? .{5,40} into", "secures? offtake", "secures? funding",
    "delivering sustainable solar power across", "sustainable solar power across the world", "the future of energy",
    "powering a sustainable", "leading the energy transition", "^our ", "^the future",
    "grazing (?:merinos?|fleece|sheep|cattle)", "merinos? flock", "fashion house", "paddocks? to power", "rise of small",
    "accommodation with", "solar farm accommodation",
    r"^\d+% (?:wind|solar)", "the power behind", "bess boom", r"^.{0,3}\z",
    "careers? guide", "industry snapshot", "^clean energy australia", "^annual report", "^working in ", "^find out more",
    "^use our ", "^discover ", "^about (?:us|our|the )", "^get in touch", "^join (?:us|the|our)", "^read the",
    "^download (?:the|our)", "^subscribe", "^newsletter", r"^media release\z", "^fact sheet", r"^faqs?\z", r"^resources?\z",
    r"^publications?\z", "^contact us",
)

FOREIGN_PLACES = (
    "liberia|africa|india|china|uk |united kingdom|usa |united states|europe|middle east|kenya|nigeria|ghana|pakistan|indonesia"
    "|vietnam|philippines|bangladesh|myanmar|cambodia|laos|thailand|malaysia|singapore|taiwan|korea|japan|new mexico|colorado"
    "|california|texas|florida"
)

PROJECT_SHAPE = (
    r"solar\s+farm|solar\s+park|solar\s+project|solar\s+hub|solar\s+station|bess|battery\s+storage|energy\s+hub|energy\s+park"
    r"|power\s+station|hybrid\s+solar|solar\s+and\s+battery|battery\s+and\s+solar|solar\s+storage|solar\s+plus|wind\s+farm"
)

GENERIC_MAILBOX = (
    "info|admin|contact|hello|enquiries|enquiry|general|mail|projects|team|reception|office|support|sales|media|pr|news"
    "|communications|renewables|solar|wind|energy|development|planning|noreply|no-reply|webmaster|postmaster|feedback|accounts"
    "|billing|hr|jobs|careers|connect|update|newsletter|marketing|ops|operations"
)

GENERIC_PREFIXES = (
    "info@", "admin@", "contact@", "hello@", "enquiries@", "enquiry@", "general@", "mail@", "projects@", "team@", "reception@",
    "office@", "support@", "sales@", "media@", "pr@", "project@", "feedback@",
)

INVALID_DOMAINS = (
    "cer.gov.au", "cleanenergyregulator.gov.au", "dcceew.gov.au", "energy.gov.au", "aemo.com.au", "epa.gov.au", "epa.govt.nz",
    "gov.au", "govt.nz", "gov.uk", "ac.uk", "harvard.edu", "stanford.edu", "mit.edu", "edu.au", "edu.nz",
    "gmail.com", "yahoo.com", "hotmail.com", "outlook.com", "icloud.com", "aol.com", "live.com", "mail.com", "protonmail.com",
    "proton.me", "zoho.com", "fastmail.com",
)

COMMON_COMPANY_WORDS = (
    "energy", "solar", "power", "renewables", "wind", "battery", "storage", "pty", "ltd", "limited", "group", "holdings",
    "corporation", "inc", "co", "company", "australia", "new", "zealand", "nz", "au", "and", "the", "of", "green", "gold",
    "pacific", "blue", "red", "north", "south", "east", "west", "renewable", "clean", "project", "development", "projects",
    "international", "global", "national", "regional", "local", "urban", "rural", "metro",
)

CONTACT_STOP_WORDS = (
    "pty|ltd|limited|group|holdings|inc|corp|co|company|australia|energy|solar|power|renewables|renewable|green|clean|au|nz"
)

COMPANY_SUFFIXES = (
    r"pty\s+ltd\.?", r"ltd\.?", "limited", "pty", "group", "australia", "holdings", "corporation", r"inc\.?", "llc", r"co\.?",
    "company", "international",
)

NOT_A_PERSON = (
    "New Zealand|South Australia|Western Australia|New South Wales|North Queensland|Clean Energy|Solar Farm|Wind Farm"
    "|Battery Storage|Energy Park|Power Station|Project Manager|Development Manager|Business Development|Executive Director"
    "|Chief Executive|Managing Director|General Manager|Senior Manager|Project Director|Head Office|Annual Report|Privacy Policy"
    "|All Rights|Sunshine Estate|Global Ratings|Search Clear|Presentations? Videos?|Kurow Development Team|Unknown Developer"
    "|Project Team|Development Team|Our Team|The Team"
)

TITLE_SCORES = (
    ("business develop", 10), ("project director|head of (project|develop)", 9), ("development director|director of develop", 9),
    (r"managing director|chief executive|^ceo\z", 8), ("general manager|country manager", 7),
    ("project manager|development manager", 6), ("commercial manager|bd manager", 5),
)

NON_DEVELOPER_HOSTS = (
    "abc.net.au", "reneweconomy.com.au", "arena.gov.au", "pv-magazine-australia.com", "esdnews.com.au", "solarquarter.com",
    "greenreview.com.au", "businessdesk.co.nz", "cer.gov.au", "planningportal.nsw.gov.au", "epa.tas.gov.au", "transpower.co.nz",
    "epa.govt.nz", "ea.govt.nz", "fasttrack.govt.nz", "wikipedia.org", "youtube.com", "linkedin.com", "facebook.com",
    "twitter.com", "instagram.com", "reddit.com", "theaustralian.com.au", "afr.com", "smh.com.au", "theage.com.au",
    "heraldsun.com.au",
)

#: Headers of an uploaded spreadsheet that stand for a field, in the order in which they are looked for.
UPLOAD_HEADERS = {
    "epbc_number": ("epbc number", "epbc no", "referral number", "epbc"),
    "project_name": ("project", "project name", "title"),
    "proponent": ("proposer", "proposer/approval holder", "proponent", "approval holder"),
    "location": ("location",),
    "industry_type": ("industry type", "industry"),
    "referral_date": ("valid date", "referral date", "date referred", "referral started"),
    "project_status": ("project status", "status"),
    "state": ("primary jurisdiction", "jurisdiction", "state"),
    "decision_status": ("decision status", "decision"),
}
#: Words in the titles of news cards.
SOLAR_TITLES = ("solar", "pv", "photovoltaic", "hybrid solar", "solar farm", "solar park", "solar project", "solar and battery", "solar bess")
#: Words that make a contact's name one of a team rather than of a person.
NOT_ONE_PERSON = "team|group|office|crew|solar|renewables|energy"
#: Units of a capacity, and what follows one that is a market's rather than a project's.
UNITS = ("mw", "gw", "megawatt", "gigawatt")
MARKET_PHRASES = (
    "cumulative", "total", "installed", "of solar", "of renewable", "of wind", "of bess", "of battery",
    "capacity in australia", "capacity in new zealand", "across australia",
)
#: First cells of header rows in newsletter tables, and states of rows in them that are news.
MILESTONE_HEADERS = ("project", "status", "developer", "state", "country")
MILESTONE_STATES = ("added to", "proposed", "being assessed", "under assessment", "split from")
MILESTONE_UNDER_WAY = ("being assessed", "under assessment")
#: Kinds and states of embedded records that count as early, and states of snapshot records.
EARLY_TYPE = "in development|announced|planning|proposed"
EARLY_STATUS = "in development|under development|announced|planning"
SNAPSHOT_STATUSES = ("Proposed", "Approved", "Committed", "Committed (FID)")

# End of the fixed values.

#: White space as browsers and script engines see it; Java's \s is ASCII alone.
SPACE = "[\\s ﻿  -     　]"


#: Characters, for rules that go by offsets: white space is that of `SPACE`.
WHITE = frozenset("\t\n\v\f\r \u00a0\u1680\u2028\u2029\u202f\u205f\u3000\ufeff" + "".join(map(chr, range(0x2000, 0x200B))))
DIGITS = frozenset("0123456789")
LETTERS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
MAILBOX = LETTERS | DIGITS | frozenset("._%+-")
DOMAIN = LETTERS | DIGITS | frozenset(".-")


def whole_word(pattern: str) -> str:
    """The pattern between ASCII word boundaries (Java's \\b is Unicode-aware, ours must not be)."""
    return f"(?<![A-Za-z0-9_])(?:{pattern})(?![A-Za-z0-9_])"


def any_of(literals: tuple[str, ...]) -> str:
    """An alternation of literals, for rlike."""
    return "|".join(x.replace(".", "\\.") for x in literals)

"""Word lists, lookup values and patterns.

Everything in this module is data that results depend on, stated as plain
text; the deny hosts stand in a data file beside it.  No logic lives here.  Lists that a deployment will want to replace (the
niches, the deny hosts) are only defaults: every operator that uses them takes
them as a parameter.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from importlib.resources import files

# --------------------------------------------------------------------------
# E-mail, phone and social patterns
# --------------------------------------------------------------------------

EMAIL_TLDS = (
    "com", "net", "org", "io", "ca", "co\\.uk", "co", "me", "info", "biz",
    "us", "in", "de", "fr", "es", "it", "au", "nl", "se", "no", "dk", "fi",
    "pl", "cz", "eu", "ai", "dev", "agency", "studio", "site", "online",
    "business", "company",
)

OBFUSCATED_TLDS = ("com", "net", "org", "io", "co", "in", "co\\.uk")

# Replacements applied in this order to an obfuscated address.
OBFUSCATION_STEPS = (
    (" [at] ", "@"), ("[at]", "@"), (" at ", "@"), ("(at)", "@"),
    (" [dot] ", "."), ("[dot]", "."), (" dot ", "."), ("(dot)", "."),
    (" ", ""),
)

CALLING_CODES_2 = (
    "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43",
    "44", "45", "46", "47", "48", "49", "51", "52", "53", "54", "55", "56",
    "57", "58", "60", "61", "62", "63", "64", "65", "66", "81", "82", "84",
    "86", "90", "91", "92", "93", "94", "95", "98",
)
CALLING_CODES_3 = (
    "212", "213", "234", "351", "352", "353", "354", "355", "356", "357",
    "358", "359", "370", "371", "372", "373", "374", "375", "376", "377",
    "380", "381", "385", "386", "387", "420", "421", "966", "971", "972",
    "973", "974", "975", "976",
)

INSTAGRAM_SKIP_PATHS = (
    "p", "reel", "reels", "explore", "share", "static", "tv", "create",
    "stories", "locations", "accounts", "discover", "directory", "csr",
    "privacy", "terms", "about", "help", "developer", "challenge", "oembed",
)
INSTAGRAM_SKIP_HANDLES = (
    "share", "tag", "p", "reel", "reels", "explore", "instagram",
    "instagood", "follow", "followers", "tiktok", "facebook",
    "yourprofile", "yourusername", "username", "yourhandle", "profile",
)
PROFILE_URL_SKIP_PATHS = (
    "p", "reel", "reels", "explore", "share", "tv", "stories", "locations",
    "accounts", "directories", "legal", "privacy", "about", "help",
)

NOISE_EMAIL_DOMAINS = (
    "example.com", "sentry.io", "domain.com", "email.com",
    "yourdomain.com", "wordpress.com", "gravatar.com",
)
DENIED_EMAIL_SUFFIXES = (".gov", ".gov.in", ".mil")

DISPOSABLE_EMAIL_DOMAINS = (
    "mailinator.com", "guerrillamail.com", "guerrillamail.net",
    "tempmail.com", "throwaway.email", "temp-mail.org", "fakeinbox.com",
    "sharklasers.com", "guerrillamailblock.com", "grr.la", "dispostable.com",
    "yopmail.com", "yopmail.fr", "maildrop.cc", "mailnesia.com",
    "trashmail.com", "trashmail.net", "trashmail.org", "10minutemail.com",
    "getnada.com", "emailondeck.com", "mohmal.com", "burnermail.io",
    "harakirimail.com", "tmpmail.net", "tmpmail.org",
)

# Generic mailboxes, in the order they are tried.
GENERIC_MAILBOXES = (
    "info", "hello", "contact", "admin", "office", "sales", "enquiries",
    "reception", "booking", "mail",
)
MAX_INFERRED_MAILBOXES = 6

# Patterns (Java dialect; U makes \\w, \\s and \\b cover all of Unicode).  A match
# begins where a run of its characters does, or right behind the match before it:
# any later start would end in the same place, so a run is read once.
_RUN_START = r"(?:\G|(?<![\w.+-]))"
EMAIL_PATTERN = rf"(?iU){_RUN_START}[\w.+-]++@[\w-]+\.(?:{'|'.join(EMAIL_TLDS)})\b"
OBFUSCATED_EMAIL_PATTERN = (
    # Parts beyond 254 characters could only give an address that is too long.
    rf"(?iU){_RUN_START}[\w.+-]{{1,254}}\s*+\[?\(?\s*+(?:at|@)\s*+\)?\]?\s*+[\w-]{{1,254}}\s*+\[?\(?\s*+"
    rf"(?:dot)\s*+\)?\]?\s*+(?:{'|'.join(OBFUSCATED_TLDS)})\b"
)
PHONE_PATTERN = (
    r"(?U)(?=[+(0-9])(?:(?:\+?[0-9]{1,3}[\s.-]?)?\([0-9]{2,4}\)[\s.-]?[0-9]{3}[\s.-]?[0-9]{4}"
    r"|(?:\+?[0-9]{1,3}[\s.-]?)?[0-9]{2,4}[\s.-]?[0-9]{3,4}[\s.-]?[0-9]{3,4})"
)
WHATSAPP_PATTERN = (
    r"(?i)(?:wa\.me/(?:widget/)?|api\.whatsapp\.com/send[^\"']*?phone=)([0-9]{7,15})"
)
AT_HANDLE_PATTERN = r"(?iU)(?<!\w)@([a-zA-Z0-9_][a-zA-Z0-9_.]{1,29})"
INSTAGRAM_LINK_PATTERN = (
    r"(?i)(?:https?://)?(?:www\.)?instagram\.com/([a-zA-Z0-9_.]{1,30})"
)
LINKEDIN_PATTERN = (
    r"(?i)https?://(?:www\.)?linkedin\.com/(?:company|in|school)/[a-zA-Z0-9\-_./%]+"
)
CLOUDFLARE_PATTERN = 'data-cfemail="([0-9a-fA-F]+)"'
PERCENT_EMAIL_PATTERN = r"(?i)(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]+%40[A-Za-z0-9._%-]+"
MAILTO_PATTERN = r"""(?i)href\s*=\s*["']mailto:([^"'>\s]+)"""
FILE_LIKE_HANDLE_PATTERN = r"\.(?:js|css|png|jpe?g|gif|svg|json|html?|php)$"

# --------------------------------------------------------------------------
# URL rules
# --------------------------------------------------------------------------

DENIED_HOST_SUFFIXES = (
    ".gov", ".gov.in", ".gov.uk", ".gov.au", ".gov.tw", ".gov.sg", ".gov.cn",
    ".go.kr", ".go.jp", ".mil", ".edu", ".edu.cn", ".ac.in", ".ac.uk",
)
DENIED_HOST_MARKERS = (
    "sbi.co", ".sbi", "hdfcbank", "bseindia", "nseindia", "ibef.org",
)
DENIED_PATH_ENDINGS = (
    ".pdf", ".jpg", ".jpeg", ".png", ".gif", ".mp4", ".zip", ".doc", ".docx",
)
DENIED_PATH_FRAGMENTS = (
    "/wiki/", "/questions/", "/q/", "/topic/", "/videos/", "/video/",
    "/download/", "/feeds/", "/wp-json/", "/api/", "/search?", "/app/",
    "/listing/", "/item/", "/collections/", "/blog/", "/news/", "/articles/",
    "/resources/", "/insights/", "/guides/", "/press/", "/webinars/", "/faq/",
    "/portfolio/", "/case-studies/", "/testimonials/",
)
NON_PAGE_ENDINGS = (
    ".pdf", ".jpg", ".jpeg", ".png", ".gif", ".zip", ".csv", ".doc", ".docx",
    ".mp4",
)
CONTENT_PATH_SEGMENTS = (
    "blog", "news", "articles", "insights", "resources", "guides", "press",
    "events", "webinars", "faq", "portfolio", "case-studies", "testimonials",
    "reviews", "media",
)
# Sub-pages guessed when a site links no contact page, in this order.
GUESSED_CONTACT_PATHS = (
    "/contact", "/contact-us", "/contactus", "/contact.html",
    "/get-in-touch", "/reach-us", "/inquiries", "/enquiries", "/en",
    "/english", "/about", "/about-us", "/our-team", "/team", "/staff",
    "/people", "/impressum", "/imprint",
)

# Default deny hosts, from a data file; a deployment passes its own (any length)
# as a sequence or as a table, see operators.deny.


def packaged_hosts(name: str) -> tuple[str, ...]:
    """Hosts of a data file of the package, one a line, without comments."""
    lines = files("leadmill").joinpath("data", name).read_text("utf-8").splitlines()
    return tuple(line.strip() for line in lines if line.strip() and not line.startswith("#"))


DEFAULT_DENY_HOSTS = packaged_hosts("deny_hosts.txt")

# --------------------------------------------------------------------------
# Phrase lists for pages, titles and names (substring tests)
# --------------------------------------------------------------------------

CORPORATE_PHRASES = (
    "investor relations", "investor-relations", "market capitalization",
    "market cap", "nasdaq", "nyse", "bombay stock exchange",
    "national stock exchange", "stock exchange", "listed company",
    "listed on the", "annual report", "quarterly results", "earnings call",
    "shareholders", "fortune 500", "ftse 100", "s&p 500",
    "multinational corporation", "publicly traded", "ipo",
    "dividend declared", "global headquarters", "corporate headquarters",
    "profit after tax", "earnings before interest", "your bank",
    "tier-1 consulting", "tier 1 consulting", "global strategy consulting",
    "fortune global 500", "fortune 100", "8000 employees",
    "10000 employees", "50000+", "listed on the nyse", "gb1 emissions",
    "sti program", "board of directors", "corporate governance",
    "esg reporting", "esg report", "internal audit", "annual revenue",
    "revenues of over", "market value of over", "gross profit of over",
    "net income of over", "operating income of over",
    "pre-tax profit of over",
)
EDUCATION_PHRASES = (
    "university", "college", "university school", "admission ", "faculty of",
    "academic calendars", "courses offered", "university library",
    "results portal", "class of ",
)
PORTAL_PHRASES = (
    "sign in to your account", "create your account", "seller central",
    "become a partner", "compare & save", "compare prices",
    "membership plans available", "price comparison", "placing an order",
    "track your order",
)
REFERENCE_PHRASES = (
    "pincode", "pin code", "postal code", "postcode lookup", "census data",
    "census of india", "village directory", "business directory",
    "city directory", "address directory", "directory listing",
    "stock quote", "share price of", "weather forecast", "movie review",
    "book review", "download pdf", "read online", "free download", "lyrics",
    "obituary", "classified ads", "news aggregator",
)
PROVIDER_PHRASES = (
    "marketing agency", "digital marketing agency", "seo agency",
    "ppc agency", "web design agency", "lead generation agency",
    "email marketing agency", "inbound marketing agency",
    "performance marketing agency", "email marketing",
    "email marketing services", "bulk email service",
    "marketing automation", "lead generation services", "seo services",
    "ppc management", "web development services",
    "content marketing services", "social media marketing agency",
)
PROVIDER_NAME_PHRASES = (
    "email marketing", "digital marketing", "lead generation", " seo ",
    " seo |", "| seo", "ppc ", "web design", "web development ",
    "marketing agency", "ad agency", "social media marketing",
    "content marketing", "growth agency", "inbound marketing",
    "performance marketing", "email list", "data & design", "data | design",
)
BRAND_NAME_PHRASES = (
    "google", "microsoft", "apple", "amazon", "microsoft365", "meta ",
    "netflix", "salesforce", "oracle", "ibm", "adobe", "shopify", "stripe",
    "square inc", "hubspot", "webflow", "opencorporates",
)
JUNK_TITLE_PHRASES = (
    "sign in", "log in", "login", "download", "wikipedia", "dictionary",
    "lyrics", "watch online", "streaming", "live score", "highlights",
    "fixtures", "official website", "news", "products for sale",
    "shop online", "job openings", "careers", "free download", "check-in",
    "track order", "coupon",
)
CONTACTABLE_PHRASES = (
    "contact", "email us", "get in touch", "reach us", "inquiries",
    "enquiries", "write to us", "talk to us", "our team", "our staff",
    "about us", "we would love to hear", "send us a message", "mailto",
    "phone", "call us",
)
CHALLENGE_PHRASES = (
    "captcha", "unusual traffic", "confirm you're not a robot",
    "verify you are human", "please enable javascript",
    "challenge-platform", "anomaly detector", "access denied",
    "are you a robot",
)
# Anchor texts that announce a contact or team page (whole words).
CONTACT_ANCHOR_TEXTS = (
    "contact", "contact us", "contact-us", "contacto", "kontakt",
    "impressum", "imprint", "get in touch", "reach us", "email us",
    "write to us", "talk to us", "let's talk", "connect with us",
    "inquiries?", "enquiries?", "our team", "our staff", "our people",
    "meet the team", "about us", "about-us", "who we are",
)

# --------------------------------------------------------------------------
# Scores and limits
# --------------------------------------------------------------------------

# column -> (how many count, points each, bonus for having any)
SCORE_WEIGHTS = {
    "emails": (5, 12, 5),
    "whatsapp_numbers": (3, 8, 5),
    "instagram_handles": (3, 5, 0),
    "linkedin_urls": (3, 4, 0),
    "phones": (3, 2, 0),
}
QUALITY_BANDS = {"high": (60, 100), "medium": (30, 59), "low": (0, 29)}
CANDIDATE_MIN_SCORE = -2
RELEVANT_RATIO = 0.3
CACHE_HOURS = 168
MAX_SUBPAGES = 5
MAX_MISSES = 3

# --------------------------------------------------------------------------
# niches
# --------------------------------------------------------------------------


@dataclass(frozen=True)
class Niche:
    """One target vertical; users add their own by making more of these."""

    id: str
    label: str
    search_queries: list = field(default_factory=list)
    scope_keywords: list = field(default_factory=list)
    exclusion_keywords: list = field(default_factory=list)


NICHES = (
    Niche(
        "real_estate",
        "Real Estate & Property Development",
        [
            '"real estate" brokerage "contact us" -zillow -trulia -realtor.com',
            '"estate agency" "our team" "email"',
            '"realty" "search homes" "contact" -"for rent" -zillow',
            '"buying" "selling" "real estate" "get in touch"',
        ],
        ["real estate", "property", "realtor", "realty", "estate agent",
         "brokerage", "condos", "villas"],
        ["for sale by owner", "rental listings aggregator", "property tax",
         "municipal corporation", "ward office"],
    ),
    Niche(
        "finance",
        "Wealth Management & Finance",
        [
            '"wealth management" "our team" "contact" -investopedia -morgan',
            '"financial advisor" "office" "contact us" -investopedia',
            '"investment advisory" "about us" "contact"',
            '"financial planning" firms "get in touch"',
        ],
        ["wealth", "financial", "investment", "asset management",
         "private equity", "hedge fund", "estate planning",
         "financial planning", "advisory"],
        ["student loans", "payday"],
    ),
    Niche(
        "healthcare",
        "Private Healthcare & Clinics",
        [
            '"cosmetic clinic" "book" "contact" -nhs -doctors.org',
            '"private clinic" "our doctors" "contact us"',
            '"dental practice" "new patients" "contact"',
            '"aesthetic clinic" "before and after" "contact"',
        ],
        ["clinic", "medical", "dentistry", "dental", "dermatology",
         "surgery center", "aesthetic", "med spa", "healthcare"],
        ["government", "public hospital"],
    ),
    Niche(
        "legal",
        "Law Firms & Legal Services",
        [
            '"law firm" "attorneys" "contact" -legalaid',
            '"business law" firm "get in touch"',
            '"corporate lawyers" "our team" "contact"',
            '"law firm" "practice areas" "contact us"',
        ],
        ["law firm", "attorney", "lawyers", "legal", "solicitors",
         "barristers", "litigation", "counsel"],
        ["legal aid", "pro bono"],
    ),
    Niche(
        "saas",
        "SaaS & Software Companies",
        [
            '"software" company "request a demo"',
            '"saas" "schedule a demo" "contact"',
            '"b2b" "software product" "book a demo"',
            '"platform" "talk to sales" "pricing"',
        ],
        ["software", "saas", "platform", "cloud", "solutions", "tech", "app",
         "api"],
        ["freelance", "portfolio"],
    ),
    Niche(
        "ecommerce",
        "E-commerce & D2C Brands",
        [
            '"d2c" brand "contact us" -flipkart -amazon',
            '"online store" "about us" "contact" -shopify -ebay',
            '"direct to consumer" brand "our story"',
            '"ecommerce" brand "customer support"',
        ],
        ["shop", "store", "brand", "d2c", "retail", "merchandise",
         "boutique"],
        ["marketplace", "walmart", "amazon seller"],
    ),
    Niche(
        "coaching",
        "High-Ticket Coaching & Consulting",
        [
            '"business coach" "work with me" -fitness -diet',
            '"executive coach" programs "contact"',
            '"consulting" "our clients" "contact us"',
            '"consultancy" "services" "contact" firm',
        ],
        ["coach", "consulting", "consultancy", "mentor", "training",
         "advisory"],
        ["diet coach", "fitness coach"],
    ),
    Niche(
        "automotive",
        "Luxury Automotive & Dealerships",
        [
            '"luxury" dealership "inventory" "contact"',
            '"exotic cars" dealership "showroom"',
            'dealership "our team" "book a test drive"',
            '"luxury" cars "our showroom" "visit us"',
        ],
        ["dealership", "luxury cars", "exotic cars", "auto", "motors",
         "vehicles", "maserati", "porsche", "range rover"],
        ["used car auction", "rental cars"],
    ),
    Niche(
        "hospitality",
        "Luxury Hospitality & Hotels",
        [
            '"boutique hotel" "reservations" "contact" -booking.com -airbnb',
            '"luxury resort" "our rooms" "contact"',
            '"fine dining" "reservations" "contact" -eventbrite',
            'hotel group "our hotels" "contact us"',
        ],
        ["hotel", "resort", "hospitality", "boutique hotel", "luxury stays",
         "restaurant group", "fine dining"],
        ["hostel", "bed and breakfast"],
    ),
)

# --------------------------------------------------------------------------
# Table layouts
# --------------------------------------------------------------------------

CONTACT_LISTS = (
    "emails", "whatsapp_numbers", "instagram_handles", "linkedin_urls",
    "phones",
)
EXPORT_COLUMNS = (
    "business_name", "niche", "website", "emails", "whatsapp_numbers",
    "instagram_handles", "linkedin_urls", "phones", "source_query",
    "quality_label", "quality_score", "email_origin", "scraped_at",
)
LIST_SEPARATOR = " | "

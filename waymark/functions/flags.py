"""Structured flags of a response, from its body and headers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import ascii_bounds, header, once

# Page generators that count.
GENERATORS = ("WordPress", "Joomla", "Drupal", "MediaWiki", "Ghost", "Hugo", "Jekyll", "Squarespace", "Wix", "Weebly", "Pelican", "Haddock", "Gatsby", "Next.js", "Nuxt", "VitePress", "Docusaurus", "Grav", "Concrete5", "TYPO3", "MODX", "ExpressionEngine", "October CMS", "CraftCMS", "Statamic", "Kirby")
# Patterns of content management systems.
SYSTEMS = {
    "wordpress": "wp-content/|wp-includes/|wordpress",
    "joomla": "joomla|/components/com_|media/",
    "drupal": "drupal|/sites/default/files|core/misc/drupal",
    "mediawiki": r"mediawiki|/w/load.php|/index\.php.*action=",
    "ghost": "ghost-|/ghost/",
    "concrete5": "concrete/|cms_theme/",
}
# Signs of a published key, of a contact form, and of links to social sites.
PGP = r"""<[^>]+content=["']application/pgp-keys["']|-----BEGIN PGP PUBLIC KEY BLOCK-----|--begin pgp public key block--|armour.*public.*key|\.asc\b.*pgp|gpg.*fingerprint"""
CONTACT = r"""class[^>]*="contact"|contact.*form|tor.*contact|onion.*contact|idiot\.onion"""
SOCIAL = {"twitter": r"(?:twitter\.com|x\.com)/\w+", "mastodon": r"mastodon\.|/\.\w+/@\w+", "github": r"github\.com/\w+", "telegram": r"telegram\.(?:me|org)/\w+"}
EMAIL = r"(?i)[a-z0-9_.+-]+@[a-z0-9-]+\.[a-z]{2,}"
# Header patterns of proxies, and words of the Server header that name one.
PROXY_HEADERS = {"cloudflare": "cf-ray|cf-cache-status|cf-request-id|x-cloudflare-|cdn-cgi", "akamai": "akamai|x-akamai"}
PROXY_SERVERS = {
    "cloudflare": ("cloudflare", "cf-", "cdn-cgi"),
    "akamai": ("akamai", "x-akamai"),
    "fastly": ("fastly", "x-served-by"),
    "varnish": ("varnish", "x-varnish"),
    "squid": ("squid", "via.*squid"),
    "nginx/cdn": ("nginx.*cdn", "cdn.*nginx"),
}
# Patterns of forum software.
FORUMS = {
    "phpBB": r"phpbb|/styles/.*/theme/|forum\.php",
    "XenForo": r"xenforo|/xf\.|js/xenforo\.min\.js",
    "Discourse": "discourse|data-controller=|discourse-helpers.js",
    "vBulletin": r"vbulletin|/clientscript/vb\.|/forum\.php",
    "Flarum": "flarum|/extensions/|flarum-header",
    "IPS (Invision)": "invision|/uploads/|ipsTemplate",
}


def _flag(kind: str, value: Column) -> Column:
    return once(value, lambda v: F.when(v.isNotNull() & (v != ""), F.struct(F.lit(kind).alias("type"), v.alias("value"))))


def _named(text: Column, patterns: dict[str, str], fold: bool = True) -> list[Column]:
    return [F.when(text.rlike(("(?i)" if fold else "") + p), F.lit(n)) for n, p in patterns.items()]


def robots_flag(body: Column) -> Column:
    """A page that quotes robots rules: any `Disallow: /...` right after `User-agent: *` counts as all."""
    low = F.lower(F.substring(body, 1, 32768))
    return F.when(low.rlike(r"user-agent\s*:\s*\*\s*\n\s*disallow\s*:\s*/\s*"), "disallow_all").when(low.contains("user-agent") & low.contains("disallow:"), "partial_block")


def techniques(body: Column, headers: Column) -> Column:
    part = F.substring(body, 1, 32768)
    made_by = F.trim(F.regexp_extract(part, r"""(?i)<meta[^>]+name=["']?generator["']?\s+content=["']([^"']+)[ "']""", 1))
    known = F.lower(made_by).rlike("|".join(f"\\Q{g.lower()}\\E" for g in GENERATORS))
    found = [F.nullif(header(headers, "Server"), F.lit("")), F.nullif(header(headers, "X-Powered-By"), F.lit("")), F.when((made_by != "") & known, made_by), *_named(part, SYSTEMS)]
    return F.array_join(F.slice(F.array_compact(F.array(*found)), 1, 5), ", ")


def proxies(headers: Column) -> Column:
    every = F.coalesce(headers, F.create_map().cast("map<string,string>"))
    names, values = (F.lower(F.array_join(x, " ")) for x in (F.map_keys(every), F.map_values(every)))
    server = F.lower(header(headers, "Server"))
    found = [F.when(names.rlike(p) | values.rlike(p), F.lit(n)) for n, p in PROXY_HEADERS.items()]
    found += [F.when(server.rlike("|".join(f"\\Q{w}\\E" for w in ws)), F.lit(n)) for n, ws in PROXY_SERVERS.items()]
    return F.array_join(F.array_distinct(F.array_compact(F.array(*found))), ", ")


def flags(body: Column, headers: Column, redirect_depth: Column) -> Column:
    """The flags of a response, an array of (type, value): robots, techniques, contacts, proxies, forums, redirects."""
    part = F.substring(F.coalesce(body, F.lit("")), 1, 32768)
    low = F.lower(part)
    mails = F.regexp_count(part, F.lit(EMAIL))
    social = F.array_compact(F.array(*_named(part, SOCIAL)))
    found = [
        _flag("robots_txt", robots_flag(part)),
        _flag("tech_stack", techniques(part, headers)),
        _flag("contact_signal", F.when(mails > 0, F.concat(F.lit("email_address_in_page ("), mails, F.lit(" addr(s))")))),
        _flag("contact_signal", F.when(part.rlike(ascii_bounds(f"(?i){PGP}")), "pgp_key_found")),
        _flag("contact_signal", F.when(low.rlike(CONTACT), "tor_contact_form")),
        _flag("contact_signal", F.when(F.size(social) > 0, F.concat(F.lit("social_links ("), F.array_join(social, ", "), F.lit(")")))),
        _flag("proxy_indicator", proxies(headers)),
        *[_flag("forum_software", x) for x in _named(low, FORUMS, fold=False)],
        _flag("redirect_chain", F.when(redirect_depth > 1, F.concat(F.lit("depth="), redirect_depth))),
    ]
    return F.array_compact(F.array(*found))


def flag_lines(found: Column) -> Column:
    """Summary lines of four types of flags."""
    line = lambda f: F.when(f["type"] == "robots_txt", F.concat(F.lit("Access policy: "), f["value"])).when(f["type"] == "contact_signal", F.concat(F.lit("Contact: "), f["value"])).when(f["type"] == "forum_software", F.concat(F.lit("Forum software: "), f["value"])).when(f["type"] == "redirect_chain", F.concat(F.lit("Redirect chain: depth "), F.substring_index(f["value"], "=", -1)))
    return F.array_compact(F.transform(found, line))

"""Replacement pools. All of them can be swapped through ``Pools``."""

from __future__ import annotations

from dataclasses import dataclass, field

# The entries and their order decide which replacement a value gets, so
# tables masked earlier keep joining with tables masked here only while these stay as is.

NAMES = (
    "Alice Martin", "Bob Chen", "Carol Davis", "David Kim", "Eva Rossi",
    "Frank Müller", "Grace Okafor", "Henry Patel", "Iris Johansson", "James Torres",
    "Karen Nguyen", "Liam O'Brien", "Mia Fernandez", "Noah Petrov", "Olivia Yamamoto",
    "Paul Andersen", "Quinn Mwangi", "Rachel Kowalski", "Sam Eriksson", "Tina Dubois",
)

EMAIL_USERS = (
    "alice", "bob", "carol", "david", "eva", "frank", "grace", "henry", "iris", "james",
    "karen", "liam", "mia", "noah", "olivia", "paul", "quinn", "rachel", "sam", "tina",
    "user", "contact", "info", "hello", "admin", "support", "test", "demo", "example", "anon",
)

EMAIL_DOMAINS = (
    "example.com", "mail.test", "placeholder.org", "fake.net", "anon.io",
    "sample.co", "dummy.com", "noreply.dev", "redacted.net", "obscured.org",
)

COUNTRIES = (
    "Argentina", "Australia", "Brazil", "Canada", "Chile", "Colombia", "Egypt",
    "France", "Germany", "Ghana", "India", "Indonesia", "Italy", "Japan",
    "Kenya", "Mexico", "Netherlands", "Nigeria", "Norway", "Pakistan", "Peru",
    "Philippines", "Poland", "Portugal", "South Africa", "South Korea", "Spain", "Sweden",
    "Thailand", "Turkey", "Ukraine", "United Kingdom", "United States", "Vietnam", "Zimbabwe",
)

CATEGORIES = (
    "Alpha", "Beta", "Gamma", "Delta", "Epsilon", "Zeta", "Eta", "Theta", "Iota", "Kappa",
    "Lambda", "Mu", "Nu", "Xi", "Omicron", "Pi", "Rho", "Sigma", "Tau", "Upsilon",
)

DEFAULT_CATEGORY = "Default"

MERCHANTS = {
    "Travel": (
        "Sky Airways Int'l", "Horizon Hotels Group", "Metro Transit Authority", "Pacific Car Rentals",
        "Summit Travel Agency", "Coastal Cruise Lines", "Atlas Rail Services", "Pioneer Bus Co",
    ),
    "Bills & Utilities": (
        "Greenfield Energy Co", "Clearwater Utilities", "Metro Power Corp", "Sunrise Communications",
        "National Gas & Electric", "Citywide Water Services", "BrightNet Internet", "HomeSafe Insurance Co",
    ),
    "Professional Services": (
        "Oakwood Consulting LLC", "Sterling Legal Group", "Apex Accounting Services", "Northstar Tax Advisors",
        "Bridgepoint Financial", "Keystone Business Solutions", "Meridian HR Partners", "Pinnacle IT Services",
    ),
    "Food & Drink": (
        "Golden Fork Bistro", "Fresh Harvest Market", "Sunrise Cafe & Bakery", "The Corner Deli",
        "Maple Street Brewery", "Ocean Grill Restaurant", "Quick Bites Express", "Garden Valley Grocers",
    ),
    "Shopping": (
        "Marketplace General Store", "Urban Style Outfitters", "Cornerstone Hardware", "Elm Street Electronics",
        "Lakeside Home Goods", "Summit Sports & Outdoors", "Birchwood Pharmacy", "Central Office Supplies",
    ),
    "Health & Wellness": (
        "Vitality Health Clinic", "Harmony Wellness Center", "Peak Fitness Studio", "Lakeside Medical Group",
        "Serenity Spa & Body", "ClearView Eye Care", "Evergreen Dental Office", "Balanced Life Chiropractic",
    ),
    "Entertainment": (
        "Starlight Cinema", "Echo Music Lounge", "Riverside Arcade & Games", "Summit Streaming Media",
        "Phoenix Concert Hall", "Lakeview Sports Arena", "Crescent Theater Co", "Digital Worlds Gaming",
    ),
    "ATM/Cash": (
        "National Bank ATM", "Community Credit Union ATM", "Metro Cash Depot",
        "First Federal ATM", "Citywide Cash Access", "Allied Bank ATM",
    ),
    "Transfer": (
        "Interbank Transfer", "Online Fund Transfer", "Wire Transfer Service",
        "Mobile Pay Transfer", "Direct Deposit Transfer", "ACH Transfer Service",
    ),
    DEFAULT_CATEGORY: (
        "General Merchant Co", "Standard Services LLC", "Universal Vendors Inc", "Allied Commerce Group",
        "National Retail Corp", "Metro Business Services", "Central Processing Co", "Premier Merchant Services",
    ),
}

# End of fixed values.


@dataclass(frozen=True)
class Pools:
    """The replacement words of one run."""

    names: tuple[str, ...] = NAMES
    email_users: tuple[str, ...] = EMAIL_USERS
    email_domains: tuple[str, ...] = EMAIL_DOMAINS
    countries: tuple[str, ...] = COUNTRIES
    categories: tuple[str, ...] = CATEGORIES
    merchants: dict[str, tuple[str, ...]] = field(default_factory=lambda: dict(MERCHANTS))

    def __post_init__(self):
        if DEFAULT_CATEGORY not in self.merchants:
            raise ValueError(f"merchants need a {DEFAULT_CATEGORY!r} pool")
        lists = [self.names, self.email_users, self.email_domains, self.countries, self.categories]
        if not all(lists) or not all(self.merchants.values()):
            raise ValueError("a pool must not be empty")

    def outputs(self, field_type: str) -> list[str]:
        """Every value that a field type can produce."""
        if field_type == "name":
            return list(self.names)
        if field_type == "email":
            return [f"{user}@{domain}" for user in self.email_users for domain in self.email_domains]
        if field_type == "country":
            return list(self.countries)
        if field_type == "category":
            return list(self.categories)
        if field_type == "description":
            return sorted({word for pool in self.merchants.values() for word in pool})
        raise ValueError(f"field type without a pool: {field_type!r}")


DEFAULT_POOLS = Pools()

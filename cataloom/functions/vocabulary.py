"""Word lists, patterns and constants that the results depend on."""

from __future__ import annotations

# Catalogue segments, in their usual order.
SEGMENTS = ("gaming", "ultrabook", "business", "budget", "mainstream", "chromebook")

# Review aspects and their cues.
ASPECTS: dict[str, tuple[str, ...]] = {
    "performance": ("fast", "speed", "slow", "lag", "performance", "processor", "cpu", "ram", "boot", "responsive", "sluggish", "freeze", "powerful"),
    "battery": ("battery", "charge", "charging", "unplugged", "battery life", "power adapter"),
    "display": ("screen", "display", "monitor", "resolution", "brightness", "glare", "colors", "viewing angle", "dim", "bright"),
    "keyboard_trackpad": ("keyboard", "keys", "trackpad", "touchpad", "typing", "mouse pad", "backlit", "key travel"),
    "build_quality": ("build", "flex", "flimsy", "sturdy", "plastic", "hinge", "cheap feel", "solid", "durable", "creak"),
    "thermals_noise": ("hot", "heat", "overheat", "fan", "noisy", "loud", "thermal", "cooling", "burning", "warm"),
    "value_price": ("price", "value", "worth", "cheap", "expensive", "bargain", "money", "affordable", "overpriced"),
    "support_service": ("support", "customer service", "warranty", "return", "rma", "tech support", "refund"),
}

# Series words that hint at a segment.
GAMING_HINTS = ("alienware", "razer", "rog", "predator", "nitro", "omen", "legion", "tuf", "msi", "sager", "gigabyte", "aorus")
BUSINESS_HINTS = ("thinkpad", "latitude", "elitebook", "probook", "precision", "zbook", "travelmate", "vostro", "toughbook")
ULTRABOOK_HINTS = ("xps", "spectre", "yoga", "swift", "zenbook", "macbook air", "surface laptop", "envy", "gram")
BUDGET_CPUS = ("Celeron", "Pentium", "Atom", "A Series", "E Series", "Sempron", "MediaTek")
PREMIUM_CPUS = ("Core i7", "Core i9", "Ryzen 7", "Ryzen 9", "Core Ultra 7", "Core Ultra 9", "M1", "M2", "M3")

# What marks an accessory, another form factor, a desktop, a portable.
ACCESSORY = (
    r"(carrying case|laptop case\b|laptop sleeve|\bsleeve\b|backpack|messenger bag"
    r"|laptop bag\b|skin decal|decal sticker|vinyl decal|\bdecal\b|screen protector"
    r"|privacy (?:screen|filter)|keyboard cover|silicone keyboard|palm ?rest|cooling pad"
    r"|laptop stand\b|docking station|\blap ?dock\b|\bac adapter\b|power adapter|\bcharger\b"
    r"|replacement (?:battery|keyboard|screen|lcd|palmrest|hinge|motherboard|fan|adapter)"
    r"|\bmotherboard\b|so-?dimm|memory module|ram upgrade kit|hdd caddy|mouse pad|dry erase"
    r"|\bcapri\b|playstation|\bps5\b|\bxbox\b|all-in-one (?:computer|desktop|pc)"
    r"|desktop (?:computer|pc|tower)|operating system -)"
)
OTHER_FORM = r"(\btablet\b|\be-?reader\b|smartphone|\bcell ?phone\b|\bmonitor\b|\bhdtv\b|\btelevision\b)"
DESKTOP = r"(all[- ]?in[- ]?one\b|all in one\b|\baio\b|elitedesk|prodesk|thinkcentre|optiplex|\btower\b|micro[- ]tower|mini[- ]tower|\bsff\b|small form factor)"
PORTABLE = r"(laptop|notebook|ultrabook|chromebook|netbook|portable|macbook)"
LAPTOP = (
    r"(laptop|notebook|chromebook|ultrabook|macbook|netbook|thinkpad|ideapad|pavilion"
    r"|inspiron|latitude|elitebook|probook|aspire|vivobook|zenbook|omen|nitro|predator"
    r"|legion|toughbook|vaio|satellite|travelmate|\bxps\b|spectre|envy|yoga|swift|\bgram\b"
    r"|surface (?:laptop|book|pro)|2-?in-?1|2 in 1|convertible|clamshell)"
)
BUNDLE_BEFORE = r"(with|w/|includes?|including|bundle[ds]?|plus|\+|and)\s*$"
RENEWED = r"(renewed|refurbish|refurb\b|certified pre[- ]?owned|\bcpo\b|pre[- ]owned|off[- ]lease)"

# Sellers that aren't makers, and tokens that name no maker.
RESELLERS = (
    "amazon renewed", "amazon", "renewed", "computer upgrade king", "cuk", "oemgenuine", "excaliberpc", "hidevolution", "me2 michaelelectronics2",
    "ist computers", "tech data", "genuine", "quality refurbished computers", "discount electronics", "pc wholesale", "amazon.com", "electronics-salon",
)
NO_BRAND = ("unknown", "n/a", "na", "none", "generic", "-", "brand")

# Maker by alias.
BRAND_ALIASES = {
    "hp": "HP", "hewlett packard": "HP", "hewlett-packard": "HP", "hewlett packard enterprise": "HP", "hp inc": "HP", "compaq": "HP",
    "dell": "Dell", "dell computer": "Dell", "dell technologies": "Dell", "alienware": "Alienware",
    "lenovo": "Lenovo", "ibm": "Lenovo", "thinkpad": "Lenovo",
    "asus": "ASUS", "asustek": "ASUS", "asus computer international": "ASUS", "rog": "ASUS",
    "acer": "Acer", "gateway": "Gateway", "msi": "MSI", "micro-star international": "MSI",
    "microsoft": "Microsoft", "microsoft surface": "Microsoft", "apple": "Apple",
    "samsung": "Samsung", "samsung electronics": "Samsung", "sony": "Sony", "vaio": "VAIO",
    "toshiba": "Toshiba", "dynabook": "Toshiba", "lg": "LG", "lg electronics": "LG", "razer": "Razer",
    "gigabyte": "GIGABYTE", "aorus": "GIGABYTE", "sager": "Sager", "clevo": "Sager",
    "panasonic": "Panasonic", "fujitsu": "Fujitsu", "eluktronics": "Eluktronics", "google": "Google", "huawei": "Huawei", "xiaomi": "Xiaomi",
    "chuwi": "CHUWI", "jumper": "Jumper", "evoo": "EVOO", "rca": "RCA", "system76": "System76", "framework": "Framework", "prostar": "Prostar",
    "averatec": "Averatec", "sgin": "SGIN", "nec": "NEC", "everex": "Everex", "emachines": "eMachines", "packard bell": "Packard Bell", "raspberry pi": "Raspberry Pi",
}

# Makers looked for in a title, first match wins.
TITLE_BRANDS = (
    (r"\b(hewlett[- ]packard|hp)\b", "HP"), (r"\balienware\b", "Alienware"), (r"\bdell\b", "Dell"), (r"\b(lenovo|thinkpad|ideapad|thinkbook)\b", "Lenovo"),
    (r"\b(asus|zenbook|vivobook|rog\b)", "ASUS"), (r"\b(acer|predator|nitro)\b", "Acer"), (r"\b(msi)\b", "MSI"), (r"\b(apple|macbook)\b", "Apple"),
    (r"\b(microsoft|surface (?:laptop|book|pro|go))\b", "Microsoft"), (r"\bsamsung\b", "Samsung"), (r"\b(sony|vaio)\b", "Sony"),
    (r"\b(toshiba|dynabook|tecra|satellite)\b", "Toshiba"), (r"\brazer\b", "Razer"), (r"\b(gigabyte|aorus)\b", "GIGABYTE"), (r"\b(lg gram|lg)\b", "LG"),
    (r"\bpanasonic|toughbook\b", "Panasonic"), (r"\bfujitsu|lifebook\b", "Fujitsu"), (r"\bgateway\b", "Gateway"), (r"\bcompaq\b", "HP"), (r"\bsager\b", "Sager"),
    (r"\beluktronics\b", "Eluktronics"), (r"\bhuawei|matebook\b", "Huawei"), (r"\bgoogle|pixelbook\b", "Google"), (r"\bchuwi\b", "CHUWI"),
    (r"\bsystem76\b", "System76"), (r"\bibm\b", "Lenovo"),
)

# Processor families, first match wins: pattern, template ({0}: first group that took part), maker.
CPU_FAMILIES = (
    (r"core\s*ultra\s*([579])", "Core Ultra {0}", "Intel"),
    (r"\b(?:intel\s*)?core\s*[ _-]?i([3579])\b", "Core i{0}", "Intel"),
    (r"\bi([3579])[ -]?\d{3,5}[a-z]{0,2}\b", "Core i{0}", "Intel"),
    (r"\bcore\s*2\s*(?:duo|quad|solo)\b", "Core 2", "Intel"),
    (r"\bcore\s*duo\b", "Core Duo", "Intel"),
    (r"\bcore\s*m\d?\b|\bcore[ _-]?m\b|\bm[357][ -]?\d{4}\b", "Core M", "Intel"),
    (r"\bceleron\b", "Celeron", "Intel"),
    (r"\bpentium\b", "Pentium", "Intel"),
    (r"\batom\b", "Atom", "Intel"),
    (r"\bxeon\b", "Xeon", "Intel"),
    (r"\bryzen\s*[_ -]?([3579])\b", "Ryzen {0}", "AMD"),
    (r"\bryzen\b", "Ryzen", "AMD"),
    (r"\bathlon\b", "Athlon", "AMD"),
    (r"\bamd\s*a\d{1,2}[- ]?\d{4}\b|\ba[46810][- ]?\d{4}\b", "A Series", "AMD"),
    (r"\bamd\s*a[- ]?series\b|\ba[- ]?series\b", "A Series", "AMD"),
    (r"\bamd\s*r[- ]?series\b|\bradeon r series\b", "R Series", "AMD"),
    (r"\bamd\s*e[- ]?series\b|\be[12]-\d{4}\b", "E Series", "AMD"),
    (r"\bfx[- ]?\d{4}\b|\bamd fx\b", "FX", "AMD"),
    (r"\bturion\b", "Turion", "AMD"),
    (r"\bsempron\b", "Sempron", "AMD"),
    (r"\bphenom\b", "Phenom", "AMD"),
    (r"\bapple\s*m([1234])\b", "M{0}", "Apple"),
    (r"\bm([1234])\s*(?:pro|max|ultra)?\s*chip\b", "M{0}", "Apple"),
    (r"\bsnapdragon\b", "Snapdragon", "Qualcomm"),
    (r"\bmediatek\b|\bmt\d{4}\b", "MediaTek", "MediaTek"),
    (r"\bcore\s*solo\b", "Core Solo", "Intel"),
)
CPU_MAKERS = {
    "intel": "Intel", "amd": "AMD", "apple": "Apple", "qualcomm": "Qualcomm", "snapdragon": "Qualcomm", "mediatek": "MediaTek", "arm": "ARM", "nvidia": "NVIDIA",
    "via": "VIA", "samsung": "Samsung", "rockchip": "Rockchip", "powerpc": "PowerPC", "transmeta": "Transmeta", "ibm": "PowerPC",
}
CPU_TIER = r"(?:Core i|Ryzen |Core Ultra )([3579])$"

# Memory.
RAM_SIZES = (0.25, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0, 4.0, 6.0, 8.0, 10.0, 12.0, 16.0, 20.0, 24.0, 32.0, 36.0, 40.0, 48.0, 64.0, 96.0, 128.0)
RAM_TYPE = r"\b(lpddr5x|lpddr5|lpddr4x|lpddr4|lpddr3|ddr5|ddr4l|ddr4|ddr3l|ddr3|ddr2|dddr4|sdram|so-?dimm)\b"
RAM_TYPE_NAMES = {"dddr4": "DDR4", "ddr4l": "DDR4", "so-dimm": "Unknown", "sodimm": "Unknown", "sdram": "SDRAM"}
RAM_TITLE = (
    r"(\d+(?:\.\d+)?)\s*(gb|tb|mb)\s*(?:of\s*)?(?:lp)?(?:ddr\d\w*\s*)?(?:sdram|ram|memory)\b",
    r"\bram\s*[:=]?\s*(\d+(?:\.\d+)?)\s*(gb|tb|mb)\b",
    r"(\d+(?:\.\d+)?)\s*(gb|tb|mb)\s*(?:lp)?ddr\d\w*\b",
)
SIZE = r"(\d+(?:\.\d+)?)\s*(tb|gb|mb)\b"

# Storage.
STORAGE_TYPES = (
    (r"\be-?mmc\b", "eMMC"),
    (r"\b(ssd|solid[ -]?state|nvme|pcie|m\.?2|flash memory solid state)\b", "SSD"),
    (r"\b(hdd|hard disk drive|mechanical hard|sata hard|5400 ?rpm|7200 ?rpm)\b", "HDD"),
    (r"\b(hybrid|sshd|fusion drive)\b", "Hybrid"),
)
STORAGE_TITLE = (
    r"(\d+(?:\.\d+)?)\s*(tb|gb)\s*(?:pcie\s*|nvme\s*|m\.?2\s*|sata\s*|gen\s*\d\s*)*(?:ssd|hdd|e-?mmc|hard drive|solid state|storage)",
    r"storage\s*[:=]?\s*(\d+(?:\.\d+)?)\s*(tb|gb)\b",
)

# Graphics.
DISCRETE_GPU = (
    r"(geforce|\brtx\b|\bgtx\b|\bgtx\d|(?:geforce|nvidia)\s*mx\s?\d{3}|quadro|\bnvs\b|titan"
    r"|firepro|\bfire ?gl\b|radeon\s*(?:pro\s*)?(?:rx|hd|r[5-9])\s*\d{3,4}|radeon\s*pro\s*\d"
    r"|\brx\s*[5-7]\d{3}\b|radeon\s*r[5-9]\s*m\d{2,3}|geforce\s*gt\s?\d{3})"
)
INTEGRATED_GPU = (
    r"(intel|uhd graphics|hd graphics|iris|integrated|apple|radeon graphics|radeon vega"
    r"|rx vega [1-9]\b|rx vega 1[01]\b|vega [1-9]\b|graphics media accelerator|mediatek|adreno"
    r"|radeon\s*r[2-9]\b|\bgma\b|shared)"
)
VEGA_APU = r"rx vega \d{1,2}\b"
GPU_MODELS = (
    (r"\brtx\s*(a?\d{3,4}\s*(?:ti|super|max-q|ada)?)\b", "RTX {0}"),
    (r"\bgtx\s*(\d{3,4}\s*(?:ti|super|max-q)?)\b", "GTX {0}"),
    (r"\b(?:geforce\s*)?mx\s*(\d{3})\b", "GeForce MX{0}"),
    (r"\bquadro\s*([a-z]?\d{3,4}\s*m?)\b", "Quadro {0}"),
    (r"\bgeforce\s*(gt[x]?\s*\d{3,4}m?)\b", "GeForce {0}"),
    (r"\bradeon\s*(?:pro\s*)?rx\s*(\d{3,4}\s*[a-z]{0,2})\b", "Radeon RX {0}"),
    (r"\bradeon\s*(r[2-9]\s*m?\d{0,3})\b", "Radeon {0}"),
    (r"\b(iris xe(?:\s*max)?)\b", "Iris Xe"),
    (r"\b(iris plus|iris pro|iris)\b", "Iris"),
    (r"\buhd graphics\s*(\d{3,4})?\b", "UHD Graphics {0}"),
    (r"\bhd graphics\s*(\d{3,4})?\b", "HD Graphics {0}"),
    (r"\bradeon\s*(vega\s*\d{1,2})\b", "Radeon {0}"),
    (r"\b(radeon graphics)\b", "Radeon Graphics"),
    (r"\bapple\s*(m[1234](?:\s*(?:pro|max|ultra))?)\b", "Apple {0} GPU"),
)
GPU_MAKERS = (
    (r"nvidia|geforce|\brtx\b|\bgtx\b|quadro|\bmx\s?\d{3}\b", "NVIDIA"),
    (r"\bamd\b|radeon|firepro|\bati\b", "AMD"),
    (r"intel|uhd graphics|hd graphics|iris|graphics media accelerator", "Intel"),
    (r"apple\s*m[1234]|\bapple\b", "Apple"),
    (r"mediatek|adreno|qualcomm|mali", "Other"),
)
CHIPSET_MAKERS = (("nvidia", "NVIDIA"), ("amd", "AMD"), ("ati", "AMD"), ("intel", "Intel"), ("apple", "Apple"))

# Resolutions by class name.
RESOLUTIONS = (
    (r"\b(?:4k|uhd\+?|3840\s*x\s*2160)\b", 3840.0, 2160.0),
    (r"\b(?:qhd\+|wqxga|2560\s*x\s*1600)\b", 2560.0, 1600.0),
    (r"\b(?:qhd|wqhd|2k|1440p|2560\s*x\s*1440)\b", 2560.0, 1440.0),
    (r"\b(?:wuxga|1920\s*x\s*1200|fhd\+)\b", 1920.0, 1200.0),
    (r"\b(?:fhd|full hd|1080p|1920\s*x\s*1080)\b", 1920.0, 1080.0),
    (r"\bhd\+\b", 1600.0, 900.0),
    (r"\b(?:hd ready|hd)\b", 1366.0, 768.0),
)
OS_FAMILIES = (
    (r"chrome ?os|chromebook", "ChromeOS"),
    (r"\bmac ?os|\bos ?x\b|macbook|\bmacos\b", "macOS"),
    (r"windows|\bwin ?(?:7|8|10|11|xp|vista)\b|\bwin ?\d+\b", "Windows"),
    (r"\bubuntu\b|\blinux\b|\bmint\b|\bfedora\b|\bfreedos\b|\bdos\b", "Linux"),
    (r"\bandroid\b", "Android"),
)

# Words that are no part of a model's name.
MODEL_STOPWORDS = (
    "laptop", "notebook", "computer", "pc", "new", "newest", "latest", "premium", "flagship", "business", "home", "student", "professional", "pro", "touchscreen",
    "touch", "screen", "display", "led", "lcd", "ips", "fhd", "hd", "uhd", "qhd", "wuxga", "ssd", "hdd", "emmc", "ram", "memory", "storage", "intel", "amd", "core",
    "ryzen", "celeron", "pentium", "athlon", "nvidia", "geforce", "rtx", "gtx", "radeon", "graphics", "backlit", "keyboard", "wifi", "wi", "fi", "bluetooth", "hdmi",
    "webcam", "renewed", "refurbished", "certified", "black", "silver", "gray", "grey", "blue", "white", "red", "gold", "rose", "windows", "win", "with", "and",
    "the", "for", "inch", "inches", "thin", "light", "slim", "performance", "high", "gaming", "edition", "series", "model", "quad", "dual", "octa", "hexa", "cores",
    "core2", "bundle", "upgraded", "custom", "usb", "type", "dvd", "rw", "drive", "battery", "fast", "charging", "portable", "cheap", "office", "microsoft", "365",
)
GENERIC_MODEL = ("laptop", "notebook", "book", "pc", "computer", "series", "model", "na", "n/a")

# Similarity of segments, each unordered pair once.
AFFINITY = {
    ("gaming", "mainstream"): 0.45, ("gaming", "ultrabook"): 0.30, ("gaming", "business"): 0.25, ("gaming", "budget"): 0.10, ("gaming", "chromebook"): 0.0,
    ("ultrabook", "business"): 0.70, ("ultrabook", "mainstream"): 0.50, ("ultrabook", "budget"): 0.15, ("ultrabook", "chromebook"): 0.05,
    ("business", "mainstream"): 0.60, ("business", "budget"): 0.35, ("business", "chromebook"): 0.10,
    ("mainstream", "budget"): 0.55, ("mainstream", "chromebook"): 0.15, ("budget", "chromebook"): 0.30,
}

# Segment pairs whose medians are expected in this order.
MEDIAN_ORDER = (("chromebook", "budget"), ("budget", "mainstream"), ("mainstream", "gaming"), ("budget", "gaming"), ("budget", "ultrabook"), ("mainstream", "ultrabook"))

# How a question is read. Phrases that tell its type, hints of segments and systems, amounts, sizes, superlatives (phrase, column, ascending, name).
ASKS_COMPARISON = r"\b(compare|versus|vs\.?|difference between|better than|which is better|head to head)\b"
ASKS_RIVALS = r"\b(competitor|competitors|compete|competing|rival|rivals|alternative|alternatives|similar to|comparable to|instead of|up against|who else sells)\b"
ASKS_ADVICE = r"\b(recommend|recommendation|best|should i buy|which laptop|what laptop|suggest|looking for|good for|worth buying|top pick|pick for)\b"
ASKS_MARKET = (
    r"\b(market|segment|segments|category|categories|overall|across the|typical|average price|median price|price range|how much do|premium|landscape|distribution"
    r"|brands? charge|which brand|price gap|positioning)\b"
)
SEGMENT_HINTS = {
    "gaming": ("gaming", "gamer", "game", "esports", "fps", "rtx", "gtx"),
    "ultrabook": ("ultrabook", "thin and light", "thin-and-light", "lightweight", "portable", "travel", "ultraportable", "premium thin"),
    "business": ("business", "work", "office", "enterprise", "corporate", "professional", "productivity"),
    "budget": ("budget", "cheap", "cheapest", "affordable", "entry level", "entry-level", "inexpensive", "low cost", "low-cost"),
    "chromebook": ("chromebook", "chrome os", "chromeos"),
    "mainstream": ("mainstream", "everyday", "general purpose", "family", "all round", "all-round"),
}
OS_HINTS = {
    "Windows": ("windows", "win 10", "win 11", "windows 10", "windows 11"), "macOS": ("macos", "mac os", "macbook", "mac "),
    "ChromeOS": ("chromeos", "chrome os", "chromebook"), "Linux": ("linux", "ubuntu"),
}
PRICE_MAX = r"(?:under|below|less than|cheaper than|up to|max(?:imum)?|no more than|within|budget of)\s*(?:usd|\$)?\s*([\d,]+(?:\.\d+)?)\s*(k\b)?"
PRICE_MIN = r"(?:over|above|more than|at least|starting at|from)\s*(?:usd|\$)?\s*([\d,]+(?:\.\d+)?)\s*(k\b)?"
PRICE_BETWEEN = r"between\s*\$?\s*([\d,]+(?:\.\d+)?)\s*(?:and|-|to)\s*\$?\s*([\d,]+(?:\.\d+)?)"
PRICE_AROUND = r"(?:around|about|near|roughly|circa|~)\s*\$?\s*([\d,]+(?:\.\d+)?)\s*(k\b)?"
ASKED_RAM = r"\b(\d{1,3})\s*gb\s*(?:of\s*)?(?:ram|memory)\b"
ASKED_SCREEN = r"\b(1[0-9](?:\.\d)?)\s*(?:\"|inch|in\b|-inch)"
ASKED_TIER = r"\b(?:core\s*)?i([3579])\b|\bryzen\s*([3579])\b"
ASKED_DISCRETE = r"\b(rtx\s*\d{4}|gtx\s*\d{3,4}|discrete gpu|dedicated graphics|dedicated gpu|graphics card)\b"
ASKED_ASIN = r"\bB0[A-Z0-9]{8}\b"
SUPERLATIVES = (
    (r"\b(cheapest|least expensive|lowest priced?|most affordable)\b", "price", True, "lowest price"),
    (r"\b(most expensive|priciest|highest priced?|dearest)\b", "price", False, "highest price"),
    (r"\b(best|highest|top)[- ]rated\b|\bbest reviewed\b", "average_rating", False, "highest rating"),
    (r"\b(lightest|least heavy)\b", "weight_lb", True, "lowest weight"),
    (r"\bmost ram\b|\bmost memory\b", "ram_gb", False, "most RAM"),
    (r"\b(biggest|largest) (screen|display)\b", "screen_in", False, "largest screen"),
    (r"\bmost storage\b|\bbiggest (ssd|drive|storage)\b", "storage_gb", False, "most storage"),
)
PHRASE_END = r"\b(?:with|vs|versus|against|compares?|compared|comparison|and|or|which|who|that|for|is|are|was|were|has|have|do|does|should|under|below|over|about|than|but|instead|to)\b"
COMPARISON_SPLIT = r"\s+(?:versus|vs\.?|compares?\s+(?:with|to|against)|compared\s+(?:with|to|against)|against|or|and)\s+"
COMPARISON_OPENING = r"^\s*(how does|how do|compare|which is better[,:]?|what is the difference between|whats the difference between)\s+"
ASKED_STORAGE_GB, ASKED_STORAGE_TB = r"\b(\d{3,4})\s*gb\s*(?:ssd|storage|nvme)\b", r"\b(\d(?:\.\d)?)\s*tb\b"
PRICE_WORDS = ("price", "cost", "value", "expensive", "cheap")
NO_ENTITY = ("laptop", "laptops", "notebook", "notebooks", "computer", "computers", "machine", "machines", "one", "it", "them", "this", "that", "these", "those", "model", "models")
PHRASE_CHARS, PHRASE_WORDS = 80, 7
CAPITALISED = r"\b([A-Z][A-Za-z0-9]+(?:[ -][A-Z0-9][A-Za-z0-9]*){1,4})\b"

# Weights of a listing's score for a question.
DENSE = 0.62
POPULARITY, EVIDENCE, RATING_PRIOR, RATING_FROM = 0.07, 0.06, 0.03, 20
PER_BRAND, FLOOR = 2, 0.20

"""Word lists and rules that results depend on. All but the domains are matched against lower-cased text.

Lists without a meaning in their order are sets, by alphabet or by subject.
"""

#: Words that tokens never are.
STOP_WORDS = (
    "a", "about", "above", "after", "against", "all", "already", "also", "although", "am", "an", "and", "another", "any", "are", "aren", "aren't",
    "at", "be", "because", "been", "before", "being", "below", "between", "both", "but", "by", "can", "can't", "could", "couldn", "couldn't", "did",
    "didn", "didn't", "do", "does", "doesn", "doesn't", "doing", "don", "don't", "down", "during", "each", "even", "every", "few", "for", "from",
    "had", "hadn", "hadn't", "has", "hasn", "hasn't", "have", "haven", "haven't", "having", "he", "her", "here", "hers", "herself", "him", "himself",
    "his", "how", "however", "i", "if", "in", "into", "is", "isn", "isn't", "it", "its", "itself", "just", "ll", "many", "may", "me", "might", "much",
    "must", "mustn", "mustn't", "my", "myself", "no", "nor", "not", "now", "of", "off", "on", "only", "or", "other", "our", "ours", "ourselves",
    "out", "over", "quite", "re", "really", "s", "several", "shall", "shan", "shan't", "she", "should", "shouldn", "shouldn't", "since", "so", "some",
    "still", "such", "t", "than", "that", "the", "their", "theirs", "them", "themselves", "then", "there", "therefore", "these", "they", "this",
    "those", "though", "through", "to", "too", "under", "up", "us", "ve", "very", "was", "wasn", "wasn't", "we", "well", "were", "weren", "weren't",
    "what", "when", "where", "which", "while", "who", "whom", "whose", "why", "will", "with", "won't", "would", "wouldn", "wouldn't", "yet", "you",
    "your", "yours", "yourself", "yourselves",
)

#: Words whose share tells English text.
ENGLISH_MARKERS = (
    "a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "from", "had", "has", "have", "in", "is", "it", "not", "of", "on", "or", "that",
    "the", "this", "to", "was", "were", "with", "you", "your",
)

#: Words that an n-gram neither starts nor ends with.
NGRAM_EDGE_WORDS = (
    "a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "in", "is", "it", "not", "of", "on", "or", "that", "the", "this", "to", "was",
    "were", "with",
)

#: Phrases that no n-gram contains.
NGRAM_CHROME = (
    "advertisement continue", "average rating", "calories fat", "car deals drivenbuy", "carbohydrate sugars", "cholesterol mg",
    "confirm your address", "contest winner", "continue reading", "coverage in", "credit photo", "deals drivenbuy", "diabetic exchanges", "ease use",
    "ease use value", "editorial team", "exchanges lean", "exchanges starch", "fat mg", "fat saturated", "fiber protein", "food styling",
    "for sale near", "full list best", "get recipe", "getty images", "go recipe", "history view", "informational purposes", "istockphoto",
    "kitchen approved", "lean meat", "learn more", "list best", "load more", "loading component", "make recipe", "mg cholesterol", "mg sodium",
    "min servings", "mins prep", "nutrition facts", "photo credit", "photo taste", "please confirm", "prop styling", "protein diabetic", "read more",
    "recipe advertisement", "recipe creator", "recipe photo", "reviews average", "reviews contest", "sale near you", "saturated fat", "see full list",
    "see more", "servings test", "show more", "shutterstock", "sodium carbohydrate", "star rating", "stock photo", "sugars fiber", "test kitchen",
    "total time", "use value money", "value money", "view amazon", "view history", "view recipe", "we have coverage", "winner total",
)

#: Words that no bigram has.
NGRAM_FILLERS = (
    "back", "best", "big", "come", "easy", "end", "find", "first", "full", "get", "good", "help", "high", "keep", "last", "left", "let", "like",
    "long", "low", "make", "many", "more", "most", "much", "need", "new", "next", "old", "one", "part", "put", "right", "see", "set", "start", "sure",
    "take", "top", "try", "use", "used", "way", "well",
)

#: Words that no heading contains.
HEADING_WORDS = (
    "about", "accessibility", "advertisement", "advertising", "audience", "author", "careers", "categories", "cloudflare", "comments", "company",
    "cons", "contributor", "country/region", "deals", "disclosures", "editor", "education", "entschuldigung", "events", "facebook", "fact-check",
    "favorite", "features", "footer", "guest", "highlights", "instagram", "life-changing", "linkedin", "loading...", "menu", "more", "navigation",
    "newsletter", "overview", "pinterest", "policies", "popular", "press", "pricing", "product", "pros", "references", "returns", "sections", "shop",
    "shows", "sidebar", "sitemap", "solutions", "sources", "sponsored", "sponsorship", "subscribe", "tiktok", "trending", "twitter", "updates",
    "video:", "vogue", "welcome", "widget", "youtube",
)

#: Phrases of several words that no heading contains. A phrase that contains another one is left out: it decides nothing.
HEADING_PHRASES = (
    "access denied", "sign up", "contact us", "privacy policy", "terms of service", "cookie policy", "follow us", "connect with us",
    "customer service", "help center", "our ratings", "related posts", "recent posts", "leave a reply", "share this", "written by",
    "table of contents", "skip to content", "main content", "you may also like", "recommended for you", "select international", "keep reading",
    "what to read next", "latest comparisons", "recommended posts", "what we like", "what we don't like", "what you should know", "why i liked it",
    "why i like it", "why we picked", "reasons to buy", "reasons to avoid", "get up to", "for a limited time", "looking to expand",
    "nice to meet you", "never miss", "keep in touch", "free recipe", "sign-up for", "get new recipes", "order my new", "find a recipe",
    "monthly archive", "before you go", "keep building", "build job-ready", "we'll be right back", "loading component", "we're sorry",
    "il semble que", "lo sentimos", "siamo spiacenti", "recipe ebook", "ebook bundle", "honest, objective", "all the latest tech",
    "a top-notch team", "your security is our", "lets start learning", "don't settle for", "appointment booking", "please contact your",
    "growing zone", "life of dozer", "follow our", "unable to access", "please verify", "ray id", "just a moment", "what can i do to resolve this",
    "% off", "off your first", "free shipping", "use code", "promo code", "limited time offer", "join and save", "for sale near you",
    "find a dealer", "reply to comment", "leave a comment", "post a comment", "item added to", "add to cart", "add to bag", "new online",
    "just arrived", "in stock", "select options", "select size", "select color", "write a review", "rate this", "was this helpful", "quick links",
    "jump to", "most read", "latest stories", "latest news", "you might also like", "all templates", "create guides", "download for free",
    "download canva", "digital design", "print design", "images and photos", "videos and audio", "business plans", "track your order",
    "delivery information", "size guide", "gift cards", "customer reviews", "free delivery", "buy now", "watch the video", "video meal",
    "video inspiration", "purchase options", "best in class", "on this page", "in this article", "from mayo clinic", "cookies on",
    "national doctors", "treatment in ", "training programs", "zen habits", "nutrition information", "in-depth analysis", "expert recommendation",
    "diagnostic package", "oral appliance", "what makes", "why choose us", "our methodology", "how we test", "how we rate", "how we evaluate",
    "how we review", "how we chose", "how we selected", "how we picked", "meet the team", "meet the expert", "meet our", "fact check",
    "frequently asked questions", "key takeaways", "bottom line", "the verdict", "final thoughts", "final verdict", "our take", "related articles",
    "related content", "investor relations", "do not sell my personal", "cookie settings", "site map", "thank you for registering",
    "our top tested picks", "our top picks", "top picks at a glance", "your cart", "why trust", "contact information", "need help",
    "financial tips", "follow today", "stay up to date", "your facility", "our experts",
)

#: What no heading contains.
HEADING_BLACKLIST = (*HEADING_WORDS, *HEADING_PHRASES)

#: Keyword words that lower commercial and transactional scores.
INFO_OVERRIDES = (
    "ideas", "recipe", "recipes", "symptoms", "tips", "training",
)

#: Signals of informational intent, in order.
INTENT_INFORMATIONAL = (
    "what is", "how to", "why", "guide", "tutorial", "learn", "definition", "meaning", "example", "explain", "overview", "types of", "benefits of",
    "difference between", "history of", "introduction", "symptoms", "causes", "signs", "treatment", "recipe", "ingredients", "training", "tips",
    "ideas", "exercises", "remedies", "steps",
)

#: Signals of commercial intent, in order.
INTENT_COMMERCIAL = (
    "best", "top", "review", "comparison", "vs", "versus", "alternative", "cheap", "affordable", "recommended", "rated", "pros and cons", "which",
    "ranking", "compare",
)

#: Signals of transactional intent, in order.
INTENT_TRANSACTIONAL = (
    "buy", "price", "cost", "deal", "discount", "coupon", "sale", "order", "purchase", "shop", "free shipping", "checkout", "subscribe", "download",
    "sign up",
)

#: Signals of navigational intent, in order.
INTENT_NAVIGATIONAL = (
    "login", "sign in", "official", "website", "homepage", "contact", "support", "help center", "account", "dashboard", "app", "portal",
)

#: Tone formal, weight 3.
TONE_FORMAL_3 = (
    "aforementioned", "furthermore", "henceforth", "hereby", "methodology", "notwithstanding", "pursuant", "whereas",
)

#: Tone formal, weight 1.
TONE_FORMAL_1 = (
    "analysis", "clinical", "concluded", "data indicates", "efficacy", "evidence suggests", "findings", "hypothesis", "literature", "peer-reviewed",
    "research", "statistically", "study",
)

#: Tone casual, weight 3.
TONE_CASUAL_3 = (
    "amazing", "awesome", "game changer", "gonna", "gotta", "hands down", "honestly", "no-brainer", "super easy", "totally",
)

#: Tone casual, weight 1.
TONE_CASUAL_1 = (
    "check out", "don't worry", "easy", "hack", "here's the deal", "let's", "quick", "simple", "the thing is", "tips",
)

#: Tone technical, weight 2.
TONE_TECHNICAL_2 = (
    "algorithm", "api", "compile", "configure", "deprecat", "endpoint", "framework", "implementation", "middleware", "protocol", "refactor", "regex",
    "repository", "runtime",
)

#: Left-overs of contractions.
JUNK_CONTRACTIONS = (
    "aren", "couldn", "didn", "doesn", "hadn", "hasn", "isn", "ll", "mustn", "re", "shouldn", "ve", "wasn", "weren", "wouldn",
)

#: Names of publishers and shops.
JUNK_PUBLISHERS = (
    "aliexpress", "allrecipes", "amazon", "bankrate", "bbb", "bonappetit", "buzzfeed", "clevelandclinic", "cloudflare", "cnet", "coinmarketcap",
    "crunchbase", "ebay", "epicurious", "etsy", "facebook", "forbes", "glassdoor", "healthline", "helpguide", "hopkinsmedicine", "instagram",
    "investopedia", "laptopmag", "linkedin", "mayoclinic", "nerdwallet", "pcgamesn", "pcmag", "pinterest", "quora", "realtor", "reddit", "redfin",
    "solarreviews", "stepchange", "target", "techradar", "tiktok", "tomsguide", "tomshardware", "tripadvisor", "trustpilot", "twitter", "verywellfit",
    "verywellhealth", "verywellmind", "walmart", "wayfair", "webmd", "wikipedia", "wirecutter", "yelp", "youtube", "zappos", "zillow",
)

#: Ticker symbols.
JUNK_TICKERS = (
    "aapl", "ada", "amzn", "avax", "bnb", "btc", "doge", "dot", "eth", "goog", "googl", "jpm", "matic", "meta", "msft", "nvda", "shib", "sol", "tsla",
    "wmt", "xrp",
)

#: Words of web page furniture.
JUNK_CHROME = (
    "addbeh", "advertisement", "advertiser", "affiliate", "bevy", "browse", "buffs", "captcha", "chatbot", "classy", "cloudflare", "clunky", "cons",
    "copyright", "disclaimer", "disclosure", "doi", "editorial", "eview", "excels", "exp", "faq", "faqs", "fooled", "forbes", "freephone",
    "helpguide", "helpline", "hopkinsmedicine", "htm", "ibotta", "impressively", "inbox", "login", "logout", "msrp", "ncbi", "nccih", "newsletter",
    "nih", "opt", "password", "paywall", "permalink", "pingback", "pluses", "pmc", "podcast", "podcasts", "pricier", "pros", "refreshed", "roundup",
    "rss", "seamlessly", "shiniest", "signin", "signup", "sitemap", "specs", "sponsored", "stepchange", "subscribe", "subscribers", "tabs",
    "takeaway", "takeaways", "tasty", "tester", "testers", "testimonials", "thankfully", "trackback", "unboxing", "unsubscribe", "usability",
    "username", "vetted", "webchat", "whistles", "wholeheartedly", "yummy",
)

#: Words that a phrase neither starts nor ends with.
JUNK_EDGE_FILLERS = (
    "feel", "great", "important", "include", "issues", "look", "most", "moved", "often", "one", "per", "performed", "saved", "spp", "tested", "want",
    "without",
)

#: Names that no phrase contains.
JUNK_PUBLISHER_PARTS = (
    "allrecipes", "amazon", "bankrate", "buzzfeed", "clevelandclinic", "cnet", "coinmarketcap", "ebay", "epicurious", "forbes", "healthline",
    "investopedia", "mayoclinic", "nerdwallet", "pcgamesn", "solarreviews", "target", "techradar", "tomsguide", "tomshardware", "verywellhealth",
    "walmart", "webmd", "wirecutter",
)

#: Parts of web addresses.
JUNK_URL_PARTS = (
    ".com", ".net", ".org", ".io", ".htm", ".html", ".php", ".asp", "https", "http:", "www.",
)

#: How credits begin.
JUNK_CREDIT_PREFIXES = (
    "photograph ", "photo by ", "written by ", "reviewed by ", "edited by ", "medically reviewed ", "fact checked ", "illustration ", "credit ",
)

#: Attributions, where " by " occurs.
JUNK_BY_PHRASES = (
    "reviewed by", "written by", "edited by", "tested by", "updated by", "verified by", "checked by", "curated by",
)

#: Domains of advertising, tracking, shortening and storage.
AD_DOMAINS = (
    "amazon-adsystem.com", "amazon.jobs", "amazonaws.com", "amzn.to", "anrdoezrs.net", "apps.apple.com", "attentive.com", "attnl.tv", "awin1.com",
    "bit.ly", "blob.core.windows.net", "buff.ly", "cj.com", "cloudfront.net", "comenity.net", "commission-junction.com", "cookiebot.com",
    "criteo.com", "cutt.ly", "doubleclick.net", "dpbolvw.net", "essentialaccessibility.com", "facebook.net", "fbcdn.net", "go.skimresources.com",
    "goo.gl", "google-analytics.com", "googleadservices.com", "googlesyndication.com", "googletagmanager.com", "greenhouse.io", "hotjar.com",
    "impact.com", "is.gd", "jdoqocy.com", "jobs.lever.co", "levelaccess.com", "mixpanel.com", "moatads.com", "onetrust.com", "optimizely.com",
    "outbrain.com", "ow.ly", "partnerize.com", "play.google.com", "pntra.com", "privacyportal.onetrust.com", "rb.gy", "segment.com", "shareasale.com",
    "shopifycdn.com", "shorte.st", "squarespace-cdn.com", "storage.googleapis.com", "strava.com", "t.co", "taboola.com", "termly.io", "threads.com",
    "tinyurl.com", "tkqlhce.com", "trustarc.com", "usrfiles.com", "v.gd", "wixmp.com", "wixstatic.com", "zappos.app.link",
)

#: Domains that are blocked from the start.
BLOCKLIST = (
    "abcnews.go.com", "adobe.com", "alibaba.com", "aliexpress.com", "amazon.ca", "amazon.co.uk", "amazon.com", "amazon.de", "amazon.fr", "apnews.com",
    "apple.com", "apps.apple.com", "bbc.co.uk", "bbc.com", "bestbuy.com", "bing.com", "books.google.com", "britannica.com", "bsky.app", "bsky.social",
    "cloud.google.com", "cnn.com", "costco.com", "dailymotion.com", "dictionary.com", "discord.com", "discord.gg", "ebay.com", "etsy.com",
    "facebook.com", "foxnews.com", "godaddy.com", "google.co.uk", "google.com", "homedepot.com", "huffpost.com", "ibm.com", "instagram.com",
    "linkedin.com", "live.com", "lowes.com", "maps.app.goo.gl", "maps.google.com", "mastodon.social", "merriam-webster.com", "microsoft.com",
    "myshopify.com", "nbcnews.com", "nextdoor.com", "nytimes.com", "office.com", "oracle.com", "pinterest.com", "play.google.com", "quora.com",
    "reddit.com", "reuters.com", "salesforce.com", "shopify.com", "snapchat.com", "stackexchange.com", "stackoverflow.com", "support.google.com",
    "target.com", "theguardian.com", "thesaurus.com", "threads.net", "tiktok.com", "tumblr.com", "twitch.tv", "twitter.com", "usatoday.com",
    "vimeo.com", "walmart.com", "washingtonpost.com", "wayfair.com", "wikimedia.org", "wikipedia.org", "wiktionary.org", "x.com", "youtube.com",
)

#: Parts of addresses that are no content.
JUNK_URL = (
    ".app.goo.gl", "/auth", "/cart", "/redirect", "account.", "affiliate", "anrdoezrs", "awin1.com", "checkout", "click-", "cna.st/p/",
    "discord.com/invite", "discord.gg", "dpbolvw", "go.skimresources", "howl.me", "jdoqocy", "login", "narrativ.com", "pntra.com", "rstyle.me",
    "shareasale", "signin", "signup", "tkqlhce",
)

#: Query parameters that only track.
TRACKING_PARAMS = (
    "_ga", "_gl", "dclid", "fbclid", "gclid", "gclsrc", "mc_cid", "mc_eid", "msclkid", "utm_campaign", "utm_content", "utm_medium", "utm_source",
    "utm_term",
)

#: Parts of class and id of page furniture.
CHROME_CLASSES = (
    "advert", "banner", "breadcrumb", "cart", "comment", "consent", "cookie", "gdpr", "modal", "newsletter", "pager", "pagination", "popup", "share",
    "sidebar", "social", "subscribe", "toolbar", "widget",
)

#: Roles of page furniture.
CHROME_ROLES = (
    "banner", "complementary", "contentinfo", "navigation", "search",
)

#: Ids of content roots.
ROOT_IDS = (
    "content", "main-content", "main_content", "primary-content", "post-content", "article-content", "page-content", "entry-content", "site-content",
    "body-content",
)

#: Parts of classes of content roots.
ROOT_CLASSES = (
    "post-content", "entry-content", "article-content", "article-body", "post-body", "page-content",
)

#: Marks of pages that scripts fill.
JS_MARKERS = (
    "enable javascript", "javascript is required", "__next_data__", "react-root",
)

#: Boilerplate lines contain one of these.
LINE_CONTAINS = (
    "getty images", "istockphoto", "shutterstock", "alamy", "adobe stock", "unsplash", "dreamstime", "food styling", "prop styling", "photo credit",
    "image credit", "courtesy of", "all rights reserved", "nutrition facts", "diabetic exchanges", "test kitchen approved", "recipe creator",
    "subscribe to our newsletter", "sign up for our", "get our free", "download our app", "follow us on", "share this article", "print this page",
    "share on facebook", "share on twitter", "pin it", "for informational purposes only", "not a solicitation", "should not be construed as",
    "consult your doctor", "not intended as medical advice", "affiliate links", "we may earn a commission", "we use cookies", "accept all cookies",
    "privacy policy", "terms of service", "terms and conditions", "perimeterx", "javascript is required", "enable javascript", "captcha",
    "cloudflare",
)

#: Boilerplate lines of under 100 bytes start with one of these.
LINE_PREFIX_100 = (
    "photo:", "photo by", "photograph:", "photograph ", "photography:", "photographed by", "illustration:", "illustrated by", "graphics by",
    "video by", "credit:", "image:", "source:", "via ", "written by", "reviewed by", "medically reviewed", "fact-checked by", "fact checked by",
    "edited by", "updated by", "reported by", "contributor:",
)

#: Boilerplate lines of under 100 bytes contain one of these.
LINE_BIO_100 = (
    " is a writer", " is an editor", " is a reporter", " is a journalist", " is a contributor", " is a freelance",
)

#: Boilerplate lines start with one of these.
LINE_URL_PREFIX = (
    "http://", "https://", "mailto:",
)

#: Boilerplate lines of under 120 bytes contain one of these.
LINE_URL_120 = (
    ".htm", ".php", ".asp", ".pdf", ".jpg", ".png", ".svg", "://www.",
)

#: Boilerplate lines of under 80 bytes start with one of these.
LINE_PREFIX_80 = (
    "©", "copyright", "(c) ",
)

#: Boilerplate lines of under 40 bytes contain one of these.
LINE_SOCIAL_40 = (
    " shares", " likes", " comments", " views",
)

#: Boilerplate lines contain both.
LINE_PAIRS = (("total fat", "cholesterol"), ("saturated fat", "sodium"), ("dietary fiber", "protein"), ("advertisement", "continue reading"))

#: Content types in order, then per rule: words of the keyword, and what each type gains. A rule fires once.
CONTENT_TYPES = ("how-to", "comparison", "review", "guide", "listicle", "article", "recipe", "health guide")
TYPE_KEYWORD_RULES = (
    (("how to", "step by step", "tutorial"), {"how-to": 3}),
    ((" vs ", "versus", "comparison", "compared"), {"comparison": 3}),
    (("review", "hands-on", "verdict"), {"review": 3}),
    (("guide", "beginner", "comprehensive"), {"guide": 3}),
    (("top ", "best "), {"listicle": 3}),
    (("recipe", "cook", "bake"), {"recipe": 4}),
    (("symptoms", "diagnosis", "treatment", "deficiency"), {"health guide": 4}),
    (("what is", "what are"), {"guide": 5, "how-to": -3}),
    (("cost", "price", "how much"), {"guide": 3, "how-to": -1}),
)
#: A type gains 1 if two of its page signals occur.
TYPE_PAGE_SIGNALS = {
    "how-to": ("step by step", "instructions", "tutorial", "procedure"),
    "comparison": ("vs ", "versus", "comparison", "compared", "difference between"),
    "review": ("review", "tested", "hands-on", "verdict", "rating"),
    "guide": ("complete guide", "ultimate guide", "comprehensive", "in-depth"),
    "listicle": ("top ", "best ", "ranked", "picks"),
    "recipe": ("recipe", "ingredients", "prep time", "cook time", "servings"),
    "health guide": ("symptoms", "diagnosis", "treatment", "side effects", "medication"),
}

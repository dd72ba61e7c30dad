"""Word lists, lookup tables, patterns and thresholds.

Everything in this module is a fixed value the results depend on. Order matters wherever a list is documented as
"first match wins"; no logic lives here.
"""

# --- descriptor cleanup ---

PRE_ALIASES = {
    'costco gas': 'costco gas station',
    'google *youtube': 'youtube premium',
    'dd *sprouts': 'sprouts delivery',
    'sq *el mixteco': 'el mixteco restaurant',
    'sq *yummy': 'yummy fresh restaurant',
    'sq *villa': 'villa restaurant',
    'dd *safeway': 'safeway delivery',
    'dd *kroger': 'kroger delivery',
    'dd *whole': 'whole foods delivery',
    'dd *costco': 'costco delivery',
    'google*youtube': 'youtube premium',
    'google *google one': 'google one',
    'google *play': 'google play',
    'clear *clearme': 'clearme subscription',
    'raz*indigo': 'indigo airlines',
    'raz* indigo': 'indigo airlines',
    'raz*chirukaanuka': 'indigo airlines',
    'clear*clearme': 'clearme subscription',
    'apple *': 'apple subscription',
    'uber *eats': 'uber eats',
    'uber* eats': 'uber eats',
    'ubereats': 'uber eats',
    'uber eats': 'uber eats',
    'in-n-out': 'innout burger',
    'in n out': 'innout burger',
}

ALIASES = {
    'amzn mktp': 'amazon',
    'amzn': 'amazon',
    'amazon mktplace': 'amazon',
    'amazon mktpl': 'amazon',
    'amazon.com': 'amazon',
    'uber eats': 'uber eats',
    'ubereats': 'uber eats',
    'uber *eats': 'uber eats',
    'dd *': 'doordash',
    'dsh*': 'doordash',
    'doordash': 'doordash',
    'sbux': 'starbucks',
    'wholefds': 'whole foods',
    'wholefoodsmkt': 'whole foods',
    'wfm': 'whole foods',
    'wal-mart': 'walmart',
    'wmt': 'walmart',
    'apple.com/bill': 'apple subscription',
    'itunes': 'apple subscription',
    'apple one': 'apple subscription',
    'google *youtube': 'youtube premium',
    'google*youtube': 'youtube premium',
    'google *google one': 'google one',
    'netflix.com': 'netflix',
    'spotify usa': 'spotify',
    'paypal *': '',
    'sq *': '',
    'tst* ': '',
    'toast': '',
}

STRIP_PATTERNS = [
    r"\b\d{4,}\b",
    r"\b[A-Z]{2}\b$",
    r"\b(seattle|new york|chicago|los angeles|san francisco|houston|phoenix|philadelphia|san antonio|san diego|dallas|san jose|austin|jacksonville|fort worth|columbus|charlotte|indianapolis|san francisco|denver|washington|nashville|oklahoma|el paso|boston|portland|las vegas|memphis|louisville|baltimore|milwaukee|albuquerque|tucson|fresno|sacramento|mesa|kansas|atlanta|omaha|colorado|raleigh|miami|minneapolis|cleveland|wichita|arlington|new orleans|bakersfield|tampa|aurora|anaheim|santa ana|corpus christi|riverside|st louis|lexington|pittsburgh|anchorage|stockton|cincinnati|st paul|greensboro|toledo|newark|plano|henderson|lincoln|buffalo|fort wayne|jersey city|chula vista|orlando|st petersburg|norfolk|chandler|laredo|madison|durham|lubbock|winston|garland|glendale|hialeah|reno|baton rouge|irvine|chesapeake|north las vegas|gilbert|scottsdale|shoreline|bellevue|redmond|bothell|edmonds|kirkland|tacoma|everett|issaquah|enumclaw|sunnyvale|san mateo|palo alto|mountain view|cupertino|fremont|hayward|oakland|berkeley|richmond|concord|antioch|santa rosa|petaluma|san jose|san bruno|south san francisco|daly city|san leandro|milpitas|santa clara|sunnyvale|campbell|los gatos|saratoga|los altos|menlo park|atherton|portola valley|woodside|san carlos|foster city|burlingame|millbrae|san francisco|daly city|colma|south san francisco|brisbane|pacifica|half moon bay)\b",
    r"\b(wa|ca|ny|tx|fl|il|pa|oh|ga|nc|mi|nj|va|az|ma|in|tn|mo|md|wi|mn|co|al|sc|la|ky|or|ok|ct|ut|ia|nv|ar|ms|ks|ne|nm|id|wv|hi|nh|me|ri|mt|de|sd|nd|ak|vt|wy|dc)\b",
    r"\b\d{3}[-.\s]\d{3}[-.\s]\d{4}\b",
    r"\bx+\d+\b",
    r"#\d+",
    r"\*+\w+\b",
    r"\b(ach|debit|purchase|checkcard|pos|visa|mc|mastercard|electron|contactless|tap|chip|swipe)\b",
    r"\b(des|id|indn|co id|ppd|ccd|web|tel)\b",
    r"\s{2,}",
]

PROCESSOR_PREFIX = r"^(?:sq|tst|toast|dd|dsh|paypal|pp|sp|clkbank|wpy|gum|fs|ven(?:mo)?)\s*\*+\s*"

STEM_PREFIXES = [
    'recurring debit card purchase', 'recurring debit card', 'debit card purchase', 'pos purchase',
    'web pmt recur-', 'web pmt-', 'web pmt', 'direct payment - purchase', 'direct payment -',
    'direct payment', 'intl purch & adv fee', 'intl purch', 'ach tel', 'ach web', 'ach', 'checkcard',
    'check card', 'point of sale', 'pos', 'purchase authorized on', 'purchase', 'payment', 'recurring',
    'debit card', 'card',
]

BRANDS = {
    'amazon': ['amazon', 'amzn', 'amazon mktpl', 'amazon mktp', 'amazon.com', 'amazon prime', 'amzn mktp', 'amazon web'],
    'walmart': ['walmart', 'wal-mart', 'wal mart', 'wm supercenter', 'walmart.com'],
    'target': ['target', 'targ ', 'targ.', 'target.com', 'target debit'],
    'costco': ['costco'],
    'kroger': ['kroger'],
    'safeway': ['safeway'],
    'trader joes': ['trader joe', 'trader joes'],
    'whole foods': ['whole foods', 'wholefds', 'wholefoods'],
    'aldi': ['aldi'],
    'publix': ['publix'],
    'vons': ['vons'],
    'albertsons': ['albertsons'],
    'sprouts': ['sprouts'],
    'starbucks': ['starbucks', 'sbux'],
    'dunkin': ['dunkin'],
    'mcdonalds': ['mcdonald', 'mcdonalds'],
    'chipotle': ['chipotle'],
    'chick-fil-a': ['chick-fil-a', 'chick fil a', 'chickfila'],
    'taco bell': ['taco bell'],
    'subway': ['subway'],
    'wendys': ['wendy'],
    'burger king': ['burger king'],
    'dominos': ['domino'],
    'pizza hut': ['pizza hut'],
    'panera': ['panera'],
    'dairy queen': ['dairy queen'],
    'in-n-out': ['in-n-out', 'in n out'],
    'popeyes': ['popeye'],
    'doordash': ['doordash', 'dd doordash', 'dd *doordash'],
    'uber eats': ['uber eats', 'ubereats'],
    'grubhub': ['grubhub'],
    'instacart': ['instacart'],
    'uber': ['uber'],
    'lyft': ['lyft'],
    'netflix': ['netflix'],
    'spotify': ['spotify'],
    'hulu': ['hulu'],
    'disney plus': ['disney plus', 'disney+', 'disneyplus'],
    'hbo max': ['hbo max', 'hbomax', 'max.com'],
    'youtube': ['youtube', 'google youtube'],
    'apple': ['apple.com', 'apple com', 'apple store', 'apple one', 'itunes', 'apple cash', 'applecard'],
    'google': ['google', 'goog '],
    'microsoft': ['microsoft', 'msft'],
    'paypal': ['paypal', 'pp *', 'pp*'],
    'venmo': ['venmo'],
    'zelle': ['zelle'],
    'cash app': ['cash app', 'cashapp', 'sq cash'],
    'klarna': ['klarna'],
    'afterpay': ['afterpay'],
    'affirm': ['affirm'],
    'cvs': ['cvs'],
    'walgreens': ['walgreens', 'walgreen'],
    'rite aid': ['rite aid'],
    'home depot': ['home depot', 'homedepot'],
    'lowes': ["lowe's", 'lowes'],
    'best buy': ['best buy', 'bestbuy'],
    'ikea': ['ikea'],
    'wayfair': ['wayfair'],
    'chevron': ['chevron'],
    'shell': ['shell oil', 'shell service', 'shell '],
    'exxon': ['exxon', 'exxonmobil'],
    '76': ['76 '],
    'arco': ['arco'],
    'bp': ['bp#', 'bp gas'],
    'mobil': ['mobil'],
    '7-eleven': ['7-eleven', '7 eleven', '7eleven'],
    'circle k': ['circle k'],
    'petsmart': ['petsmart'],
    'petco': ['petco'],
    'chewy': ['chewy'],
    'nike': ['nike'],
    'adidas': ['adidas'],
    'lululemon': ['lululemon'],
    'old navy': ['old navy'],
    'gap': ['gap.com', 'gap store'],
    'h&m': ['h&m', 'h and m'],
    'zara': ['zara'],
    'macys': ["macy's", 'macys'],
    'nordstrom': ['nordstrom'],
    'tj maxx': ['tj maxx', 'tjmaxx', 't.j. maxx'],
    'marshalls': ['marshalls'],
    'ross': ['ross stores', 'ross dress'],
    'sephora': ['sephora'],
    'ulta': ['ulta'],
    'att': ['at&t', 'att '],
    'verizon': ['verizon'],
    'tmobile': ['t-mobile', 'tmobile'],
    'comcast': ['comcast', 'xfinity'],
    'spectrum': ['spectrum'],
    'pge': ['pg&e', 'pgande', 'pacific gas'],
    'geico': ['geico'],
    'progressive': ['progressive'],
    'state farm': ['state farm'],
    'allstate': ['allstate'],
}

BRAND_STUBS = {
    'targ': 'target',
    'amzn': 'amazon',
    'sbux': 'starbucks',
    'wmt': 'walmart',
}

MONTH_WORDS = [
    'jan', 'feb', 'mar', 'apr', 'may', 'jun', 'jul', 'aug', 'sep', 'oct', 'nov', 'dec', 'january',
    'february', 'march', 'april', 'june', 'july', 'august', 'september', 'october', 'november', 'december',
]

DISPLAY_MAP = {
    'goog': 'Google Youtube',
    'yout': 'Google Youtube',
    'netf': 'Netflix',
    'spot': 'Spotify',
    'amaz': 'Amazon Prime',
    'appl': 'Apple',
    'disn': 'Disney+',
    'hulu': 'Hulu',
    'para': 'Paramount+',
    'peac': 'Peacock',
    'padl': 'Paddle',
    'runn': 'Runna',
    'wmt': 'Walmart+',
    'wall': 'Walmart+',
}

KNOWN_MERCHANTS = {
    'trader joe s': "Trader Joe's",
    'sam s club': "Sam's Club",
    'macy s': "Macy's",
    'domino s': "Domino's",
    'mcdonald s': "McDonald's",
    'wendy s': "Wendy's",
    'lowe s': "Lowe's",
    'kohl s': "Kohl's",
    'arby s': "Arby's",
    'jack in the box': 'Jack in the Box',
    'whole foods': 'Whole Foods',
    'in n out': 'In-N-Out',
    'in-n-out': 'In-N-Out',
    'chick fil a': 'Chick-fil-A',
    'chick-fil-a': 'Chick-fil-A',
    'd airy queen': 'Dairy Queen',
    'panda express': 'Panda Express',
    'olive garden': 'Olive Garden',
    'red lobster': 'Red Lobster',
    'taco bell': 'Taco Bell',
}

SMALL_WORDS = [
    'by', 'of', 'the', 'and', 'or', 'for', 'a', 'an', 'at', 'to', 'in', 'on',
]

ACRONYMS = [
    'REI', 'NTTA', 'AMC', 'ATM', 'USPS', 'AT&T', 'NYC', 'LA', 'SF', 'BBQ', 'CVS', 'TJX', 'IKEA', 'IRS',
    'DMV', 'DSW', 'IHOP', 'KFC', 'MGM',
]


# --- transaction type patterns ---

SUMMARY_KEYWORDS = [
    'opening balance', 'closing balance', 'statement balance', 'beginning balance', 'ending balance',
    'payment due', 'minimum payment', 'new balance', 'previous balance', 'total new charges',
    'total payments', 'total credits', 'finance charge', 'interest charge', 'annual fee notice',
    'continued on', 'page total', 'subtotal',
]

REIMBURSEMENT_PATTERN = r"\b(reimbursement|reimburse|expense.?refund|expense.?repay|rebate|employer.?credit|expense.?report)\b"

CASH_PATTERN = r"\b(atm.?withdrawal|cash.?withdrawal|cash.?advance|atm.?disbursement|atm.?fee|cash.?back.?at.?pos|withdrwl|withdrawal)\b"

CC_PAYMENT_PATTERN = r"\b(automatic.?payment|payment.?thank.?you|thank.?you.?payment|autopay|auto.?pay|online.?payment|mobile.?payment|payment.?received|minimum.?payment|cc.?payment|credit.?card.?payment|amex.?payment|chase.?payment|citi.?payment|discover.?payment|bofa.?payment|bank.?of.?america.?payment|apple.?card.?payment|capital.?one.?payment|american.?express.*\bpmt\b|amex.*\bpmt\b|chase.?credit.?crd|chase.?crd.*epay|applecard|gsbank.*payment|discover.*\bpmt\b|citi.*\bpmt\b|capital.?one.*\bpmt\b)\b"

LOAN_PATTERN = r"\b(mortgage|mtg.?pymt|mtg.?payment|home.?loan|auto.?loan|car.?loan|student.?loan|personal.?loan|loan.?payment|bmw.?financial|bmw.?bank|bmwfs|ally.?financial|honda.?financial|toyota.?financial|ford.?credit|gm.?financial|nissan.?motor|hyundai.?finance|lakeview|quicken.?loan|rocket.?mortgage|nationstar|mr.?cooper|freedom.?mortgage|pennymac|loandepot|sallie.?mae|navient|fedloan|mohela|nelnet|great.?lakes)\b"

INCOME_PATTERN = r"\b(payroll|direct.?dep|direct.?deposit|salary|wages|compensation|ach.?credit.?(payroll|salary|wages)|employer|stripe.?inc|adp|paychex|gusto|quickbooks.?payroll|intuit.?payroll|bamboohr|rippling|justworks|zenefits|trinet|social.?security|ssa|pension|retirement|annuity|unemployment|benefits.?payment|tax.?refund|irs.?refund)\b"

REFUND_PATTERN = r"\b(refund|reversal|chargeback|dispute.?credit|credit.?adjustment|return.?credit|merchandise.?return|cancelled.?order|price.?adjustment|goodwill.?credit)\b"

TRANSFER_PATTERN = r"\b(zelle|venmo|cash.?app|apple.?cash|google.?pay.?send|wire.?transfer|internal.?transfer|account.?transfer|transfer.?to|transfer.?from|trnsfr|ext.?trnsfr|xoom|western.?union|moneygram|wise|remitly|worldremit|paypal.?transfer|fb.?pay)\b"

FINANCING_FEE_PATTERN = r"\b(pay.?over.?time|plan.?it.?fee|installment.?fee|cash.?advance.?fee|balance.?transfer.?fee|late.?fee|foreign.?transaction.?fee|annual.?membership.?fee|new.?pay.?over.?time)\b"

STATEMENT_CREDIT_PATTERN = r"\b(platinum.?.*credit|gold.?.*credit|amex.?clear|clear.?plus.?credit|card.?credit|statement.?credit|annual.?credit|travel.?credit|digital.?entertainment.?credit|walmart.?credit|uber.?cash|saks.?credit|streaming.?credit|hotel.?credit|dining.?credit|equinox.?credit|tsa.?credit|global.?entry.?credit|cell.?phone.?credit|cashback|cash.?back.?reward|rewards.?redemption)\b"

PAYMENT_SUMMARY_PATTERN = '^(payments.{0,5}credits|payments.?and.?credits|total.?payments|new.?balance|minimum.?payment.?due|statement.?balance|previous.?balance)$'

POSITIVE_CHARGE_NAMES = [
    'amex', 'american express', 'citi', 'discover', 'apple card', 'synchrony', 'barclays',
]


# --- category patterns: (pattern, score, category) ---

CATEGORY_PATTERNS = [
    (r"\b(restaurant|cafe|coffee|starbucks|mcdonald|burger|pizza|sushi|taco|diner|bistro|bakery|donut|dunkin|chipotle|subway|wendy|kfc|popeye|panda|chick.?fil|five.?guys|shake.?shack|in.?n.?out|whataburger|ihop|denny|waffle.?house|cracker.?barrel|olive.?garden|red.?lobster|applebee|chilis|outback|cheesecake.?factory|panera|jason.?deli|dominos?|dominoes?|pizza.?hut|papa.?john|little.?caesar|sbarro)\b", 4, 'Food & Dining'),
    (r"\b(pub|tavern|deli|food.?truck|buffet|steakhouse|seafood|ramen|pho|smoothie|juice.?bar|eatery|kitchen|brasserie|trattoria|cantina|taqueria|pizzeria|grill|brew.?pub|gastropub)\b", 4, 'Food & Dining'),
    (r"\b(ethiopian|eritrean|cuisine|cuisin|cuisi|delish|african|caribbean|jamaican|thai|vietnamese|korean|mediterranean|greek|turkish|persian|lebanese|moroccan)\b", 4, 'Food & Dining'),
    (r"\b(singapore|dubai|london|paris|tokyo|seoul|bangkok|amsterdam)\b", 2, 'Food & Dining'),
    (r"\b(almond.?house|burma.?burma|premium.?lifestyle|onamalu|ikea.?india|hpcl|fern.?thai|yummy.?fresh|el.?mixteco)\b", 3, 'Food & Dining'),
    (r"\b(bagel|wok|ramen|menya|pao|noodle|noodles|udon|pho|banh.?mi|poke|dumpling|dim.?sum|hotpot|hot.?pot|izakaya|teriyaki|katsu|bibimbap|congee|gelato|creamery|patisserie|creperie|taqueria)\b", 4, 'Food & Dining'),
    (r"\b(dosa|curry|biryani|tandoor|halal|kebab|shawarma|falafel|hummus|dim.?sum|dumpling|wonton|banh|bubble.?tea|milk.?tea|boba|spring.?roll|fried.?rice|pad.?thai|poke|acai|mayuri|indian.?restaurant|nepali|desi|punjabi|masala|charminar|spice|namaste|maharaja|taj.?restaurant)\b", 4, 'Food & Dining'),
    (r"\b(latte|espresso|cappuccino|americano|matcha|chai)\b", 3, 'Food & Dining'),
    ('ubereats|uber.?eats|doordash|grubhub|postmates|seamless|caviar|gopuff', 4, 'Food & Dining'),
    (r"tst\s*\*|sq\s*\*.*(?:cafe|coffee|pizza|burger|grill|kitchen|bar|brew)", 3, 'Food & Dining'),
    (r"\b(innout|in.?n.?out|qdoba|chipotle|panera|five.?guys|whataburger|culvers|wendys|arbys|jack.?in.?the.?box|del.?taco|el.?pollo)\b", 4, 'Food & Dining'),
    (r"\b(food|eats|dining|menufy)\b", 2, 'Food & Dining'),
    (r"\b(chaat|munchen|tacos?|taqueria|gastropub|lanai|akamai|the.?buoy|sugar.?momma|sweets|dessert|ice.?cream|creamery|bakery|deli|bistro|eatery)\b", 3, 'Food & Dining'),
    (r"\b(salt.?&?.?straw|molly.?moon|kream|cold.?stone|baskin|ben.?&?.?jerry|haagen|creamery|gelato|frozen.?yogurt|froyo)\b", 4, 'Food & Dining'),
    (r"\b(safeway|kroger|whole.?foods|trader.?joe|aldi|publix|sprouts|heb|wegmans|food.?lion|stop.?shop|vons|ralphs|giant|harris.?teeter|winn.?dixie|meijer|hy.?vee|winco|smart.?final|fresh.?market|natural.?grocers|grocery.?outlet|market.?basket|stater.?bros|price.?chopper|brookshire|piggly|winn)\b", 4, 'Groceries'),
    (r"\b(grocery|groceries|supermarket|fresh.?market)\b", 4, 'Groceries'),
    (r"\b(instacart|shipt|amazon.?fresh|walmart.?grocery|sprouts.?delivery|safeway.?delivery|kroger.?delivery|whole.?foods.?delivery|costco.?delivery)\b", 3, 'Groceries'),
    (r"\bcostco\b", 4, 'Groceries'),
    (r"\b(mayuri.?foods|mayuri.?video|indian.?grocery|mayuri.?market|ethnic.?grocery|international.?market|global.?food|asian.?market|halal.?grocery|indian.?store)\b", 3, 'Groceries'),
    (r"\b(central.?market|ctrl.?mkt|ctrl.?market|town.?country.?market|metropolitan.?market|uwajimaya|h.?mart|99.?ranch|mitsuwa)\b", 4, 'Groceries'),
    (r"\b(lyft|curb|taxi|cab|rideshare|ride.?share)\b", 4, 'Transport'),
    (r"\b(chevron|shell|bp|exxon|mobil|arco|texaco|valero|sunoco|marathon|citgo|caseys|speedway|wawa|quiktrip|racetrac|circle.?k|pilot|flying.?j|loves|76.?gas)\b", 4, 'Transport'),
    (r"\b(chargepoint|tesla.?supercharger|evgo|blink|electrify.?america)\b", 4, 'Transport'),
    (r"\b(spothero|parkmobile|laz.?parking|paybyphone|parkwhiz)\b", 4, 'Transport'),
    (r"\b(ezpass|fastrak|sunpass|txtag|tolltag|ipass|peach.?pass)\b", 4, 'Transport'),
    (r"\b(hertz|avis|budget.?car|enterprise|national.?car|alamo|dollar.?rent|thrifty|sixt|turo|zipcar)\b", 4, 'Transport'),
    (r"\b(bart|wmata|cta|mbta|septa|caltrain|lirr|nj.?transit|amtrak|greyhound|megabus|good2go)\b", 4, 'Transport'),
    (r"\b(jiffy.?lube|midas|pep.?boys|autozone|oreilly|napa|mavis|firestone|discount.?tire|goodyear)\b", 3, 'Transport'),
    (r"\b(gull.?energy|conoco|phillips.?66|sinclair|valero|mini.?mart|car.?wash|brown.?bear|quick.?stop|gas.?n.?go)\b", 3, 'Transport'),
    (r"\b(fuel|gas.?station|petrol|parking|toll)\b", 2, 'Transport'),
    (r"\b(at.?t|verizon|comcast|xfinity|t.?mobile|sprint|pg.?e|con.?ed|city.?light|duke.?energy|dominion|centerpoint|spectrum|cox|fios|optimum|mediacom|frontier.?comm|windstream|centurylink|lumen|consolidated.?comm|sparklight|astound)\b", 4, 'Bills & Utilities'),
    (r"\b(electric|electricity|utility|utilities|water.?bill|sewer|gas.?bill|natural.?gas|internet|cable|broadband|wifi)\b", 4, 'Bills & Utilities'),
    (r"\b(phone.?bill|mobile.?bill|wireless.?bill|cell.?phone.?bill)\b", 3, 'Bills & Utilities'),
    (r"\b(seattle.?city.?light|puget.?sound.?energy|pse|scl.?util|seattle.?util|king.?county.?util|water.?sewer|city.?util)\b", 4, 'Bills & Utilities'),
    (r"\b(netflix|hulu|disney.?plus|hbo.?max|paramount.?plus|peacock|apple.?tv|discovery.?plus|fubo|sling|youtube.?tv|tubi|espn.?plus)\b", 5, 'Subscriptions'),
    (r"\b(spotify|apple.?music|youtube.?music|tidal|amazon.?music|pandora|siriusxm|deezer|audible)\b", 5, 'Subscriptions'),
    (r"\b(microsoft.?365|google.?one|dropbox|icloud|notion|evernote|adobe|canva|figma|creative.?cloud)\b", 4, 'Subscriptions'),
    (r"\b(chatgpt|openai|claude|midjourney|jasper|grammarly)\b", 4, 'Subscriptions'),
    (r"\b(xbox.?game.?pass|playstation.?plus|nintendo.?online|ea.?play)\b", 4, 'Subscriptions'),
    (r"\b(peloton|strava|myfitnesspal|noom|calm|headspace|beachbody)\b", 4, 'Subscriptions'),
    (r"\b(nytimes|wsj|washington.?post|substack|medium|patreon)\b", 3, 'Subscriptions'),
    (r"\b(zoom|loom|slack|github|linear|vercel|heroku|digitalocean|atlassian|jira|hubspot|salesforce)\b", 3, 'Subscriptions'),
    (r"\b(clearme|clear.?plus|tsa.?pre.?check.?member)\b", 4, 'Subscriptions'),
    (r"apple\.com/bill|itunes|google\*.*one|youtube\s*premium", 5, 'Subscriptions'),
    (r"\bwalmart\+?\s*member\b|\bwmt\s*plus\b|\bwmt\+\b", 6, 'Subscriptions'),
    (r"\bcostco\s*(?:membership|annual\s*fee|renewal|connect)\b", 6, 'Subscriptions'),
    (r"\bsam'?s?\s*club\s*(?:membership|annual\s*fee|renewal)\b", 6, 'Subscriptions'),
    (r"\bbj'?s?\s*(?:wholesale|membership|annual\s*fee)\b", 6, 'Subscriptions'),
    (r"\b(?:amazon|amzn)\s*prime\b|\bprime\s*membership\b", 6, 'Subscriptions'),
    (r"\bapple\s*one\b|\bicloud\+?\b", 6, 'Subscriptions'),
    (r"\btarget\s*circle\s*360\b|\bshipt\s*membership\b", 6, 'Subscriptions'),
    (r"\b(subscription|membership|auto.?renew|monthly.?plan|annual.?plan)\b", 2, 'Subscriptions'),
    (r"\b(kindle|kindle.?unlimited|audible)\b", 4, 'Subscriptions'),
    (r"\b(cvs|walgreen|walgreens|rite.?aid|duane.?reade|walmart.?pharmacy|costco.?pharmacy)\b", 4, 'Health'),
    (r"\b(labcorp|quest.?diagnostics|bioreference)\b", 4, 'Health'),
    (r"\b(aspen.?dental|smile.?direct|western.?dental|lenscrafters|warby.?parker|visionworks)\b", 4, 'Health'),
    (r"\b(betterhelp|talkspace)\b", 4, 'Health'),
    (r"\b(planet.?fitness|equinox|golds.?gym|la.?fitness|anytime.?fitness|crunch|orangetheory|soulcycle|crossfit|la.?fitns|fitness)\b", 4, 'Health'),
    (r"\b(kaiser|aetna|cigna|unitedhealth|bcbs|blue.?cross|blue.?shield|humana|molina)\b", 4, 'Health'),
    (r"\b(doctor|medical|dental|hospital|clinic|urgent.?care|pharmacy|drug.?store|optometry|vision)\b", 3, 'Health'),
    (r"\b(copay|deductible|prescription|therapy|telehealth|therapist)\b", 3, 'Health'),
    (r"\b(ebay|etsy|shopify|shein|temu|wish|aliexpress|wayfair|zappos)\b", 4, 'Shopping'),
    (r"\b(nordstrom|macys|bloomingdales|saks|neiman.?marcus|jcpenney|kohls|dillards)\b", 4, 'Shopping'),
    (r"\b(tjmaxx|tj.?maxx|marshalls|ross|burlington|five.?below|dollar.?tree|dollar.?general|family.?dollar)\b", 4, 'Shopping'),
    (r"\b(best.?buy|apple.?store|micro.?center|adorama|newegg|gamestop)\b", 4, 'Shopping'),
    (r"\b(gap|zara|h.?m|uniqlo|forever.?21|old.?navy|banana.?republic|jcrew|madewell|anthropologie|asos|abercrombie|ae\b|express)\b", 4, 'Shopping'),
    (r"\b(loft\b|ann.?taylor|boutique|clothing.?co|apparel|outfitters)\b", 3, 'Shopping'),
    (r"\b(ralph.?lauren|polo.?ralph|tommy.?hilfiger|calvin.?klein|lacoste|brooks.?brothers|nautica|vineyard.?vines|lululemon|patagonia.?store)\b", 4, 'Shopping'),
    (r"\b(nike|adidas|lululemon|athleta|under.?armour|reebok|new.?balance|dyson|glow.?cosmetics|pop.?mart)\b", 4, 'Shopping'),
    (r"\b(crate.?barrel|williams.?sonoma|pottery.?barn|west.?elm|ikea|homegoods|bed.?bath)\b", 4, 'Shopping'),
    (r"\b(sephora|ulta|bath.?body|the.?body.?shop)\b", 4, 'Shopping'),
    (r"\b(sams.?club|bjs.?wholesale|staples|office.?depot|officemax|road.?runner|running.?warehouse|fleet.?feet)\b", 3, 'Shopping'),
    (r"\b(sporting.?goods|big.?5|rei\b|dicks.?sporting|academy.?sports|sports.?authority|cabelas|bass.?pro|dunhams|hibbett)\b", 4, 'Shopping'),
    (r"\bamzn\b|amazon.?mktp|amazon.?mktpl", 3, 'Shopping'),
    (r"\b(pret|marks.?spencer|boots.?pharmacy|tesco|sainsbury|waitrose|carrefour|lulu.?hypermarket|noon|namshi|centrepoint)\b", 3, 'Shopping'),
    (r"\b(ticketmaster|stubhub|fandango|eventbrite|livenation)\b", 4, 'Entertainment'),
    (r"\b(amusement|bowling|golf|arcade|escape.?room|laser.?tag|trampoline|top.?golf|mini.?golf)\b", 4, 'Entertainment'),
    (r"\b(steam|playstation|xbox|nintendo|twitch|gaming|epic.?games)\b", 4, 'Entertainment'),
    (r"\b(cinemark|amc|regal|cinepolis|alamo.?drafthouse|landmark.?theat|showcase.?cinema|marcus.?theat|harkins|bow.?tie.?cinema)\b", 4, 'Entertainment'),
    (r"\b(movie|cinema|cinemas|theater|theatre|concert|imax|multiplex)\b", 3, 'Entertainment'),
    (r"\b(delta|united|american.?airlines|southwest|spirit.?airlines|indigo|indigoairlines|raz.?indigo|raz.?chirukaanuka|air.?india|vistara|spicejet|goair|akasa)\b", 4, 'Travel'),
    (r"\b(delta|united|american.?airlines|southwest|spirit.?airlines|frontier|alaska.?airlines|jetblue|hawaiian|sun.?country|indigo|raz\*indigo|etravelius)\b", 4, 'Travel'),
    (r"\b(marriott|hilton|hyatt|ihg|wyndham|best.?western|radisson|four.?seasons|ritz.?carlton|sheraton|westin|courtyard|hampton.?inn|holiday.?inn|comfort.?inn|embassy.?suites|hoxton)\b", 4, 'Travel'),
    (r"\b(expedia|booking.?com|hotels.?com|kayak|priceline|hopper|trivago|airbnb|vrbo|tripadvisor)\b", 4, 'Travel'),
    (r"\b(carnival|royal.?caribbean|norwegian.?cruise|celebrity|princess.?cruise|disney.?cruise)\b", 4, 'Travel'),
    (r"\b(hotel|resort|motel|suite|hostel|flight|airline|airfare|airport|duty.?free|gmr.?airport|terminal.?shop|hyd.?duty|intl.?airport)\b", 3, 'Travel'),
    (r"\bgmr\b", 3, 'Travel'),
    (r"\b(hair.?bar|hair.?studio|hair.?lounge|blow.?dry|blowout.?bar|bond.?hair|great.?clips|sport.?clips|supercuts|fantastic.?sams)\b", 5, 'Personal Care'),
    (r"\b(eyebrow|eye.?brow|threading|brow.?bar|brow.?studio|lash|microblading|henna.?brow)\b", 5, 'Personal Care'),
    (r"\b(salon|spa|barber|haircut|nail.?salon|nail.?bar|beauty|skincare|cosmetic|massage|waxing|esthetician|beauty.?supply)\b", 4, 'Personal Care'),
    (r"\b(geico|progressive|state.?farm|allstate|farmers.?ins|usaa|liberty.?mutual|nationwide|travelers|esurance|root|lemonade|hippo|amica|chubb)\b", 5, 'Insurance'),
    (r"\b(metlife|prudential|northwestern.?mutual|new.?york.?life|guardian|principal)\b", 4, 'Insurance'),
    (r"\b(insurance|premium|policy|coverage)\b", 2, 'Insurance'),
    (r"\b(petsmart|petco|pet.?supplies.?plus|tractor.?supply|chewy|rover|wag|pet.?evolution|pet.?supermarket|pet.?valu|spot.?pet|paw.?print|grooming|pet.?food.?express)\b", 5, 'Pets'),
    (r"\b(veterinary|veterinarian|animal.?hospital|vet.?clinic|pet.?grooming|dog.?walk|pet.?board|pet.?sit|spot.?pet)\b", 4, 'Pets'),
    (r"\b(pet.?food|dog.?food|cat.?food|pet.?supply)\b", 3, 'Pets'),
    (r"\b(home.?depot|lowes|menards|ace.?hardware|true.?value)\b", 5, 'Home Improvement'),
    (r"\b(floor.?decor|carpet.?one|empire.?flooring)\b", 4, 'Home Improvement'),
    (r"\b(contractor|renovation|remodel|plumber|electrician|handyman|roofing|hvac|landscaping)\b", 4, 'Home Improvement'),
    (r"\b(hardware|lumber|tile|grout|drywall|fixture|faucet)\b", 3, 'Home Improvement'),
    (r"\b(carters|oshkosh|gap.?kids|gymboree|childrens.?place|buy.?buy.?baby|babylist)\b", 4, 'Baby & Kids'),
    (r"\b(toys.?r.?us|learning.?express|melissa.?doug|lego)\b", 4, 'Baby & Kids'),
    (r"\b(daycare|preschool|babysitter|nanny|afterschool|childcare|montessori|kindercare|bright.?horizons)\b", 5, 'Baby & Kids'),
    (r"\b(diapers|formula|stroller|crib|nursery|pampers|huggies)\b", 4, 'Baby & Kids'),
    (r"\b(tuition|university|college|school|course|udemy|coursera|edx|certification|exam.?fee|textbook|education)\b", 4, 'Education'),
    (r"\b(kumon|sylvan|tutoring|lessons|learning.?center)\b", 4, 'Education'),
    (r"\b(etv.?web|fireworks.?university)\b", 3, 'Education'),
    (r"\b(rent|lease|apt|apartment|property.?management|realty|hoa|condo.?assoc|homeowner.?assoc|housing|landlord)\b", 5, 'Rent/Mortgage'),
    (r"\b(mortgage|mtg|lakeview|quicken.?loan|rocket.?mortgage|nationstar|mr.?cooper|freedom.?mortgage|pennymac|loandepot|caliber.?home|united.?wholesale|guild.?mortgage)\b", 5, 'Rent/Mortgage'),
    (r"\bfs.?pay.?hoa\b|\bhoa.?payment\b|\bhomeowner.?dues\b", 5, 'Rent/Mortgage'),
    (r"\b(irs|tax.?payment|property.?tax|state.?tax|franchise.?tax|dmv|vehicle.?registration|gov.?payment|usps)\b", 5, 'Government & Taxes'),
    (r"\b(overdraft|nsf.?fee|maintenance.?fee|service.?charge|account.?fee|annual.?fee|late.?fee|foreign.?transaction|cash.?advance.?fee|atm.?fee|out.?of.?network|surcharge|penalty)\b", 5, 'Bank Fees'),
    (r"\b(gofundme|kickstarter|indiegogo|red.?cross|salvation.?army|united.?way|habitat.?humanity)\b", 4, 'Gifts & Donations'),
    (r"\b(church|mosque|temple|synagogue|tithe|offering|donation|nonprofit|fundraiser|charitable)\b", 3, 'Gifts & Donations'),
    (r"\b(law.?office|legal|attorney|accounting|cpa|consultant|cleaning.?service|laundry|dry.?cleaning|alterations|notary)\b", 4, 'Professional Services'),
    (r"\b(openai|figma|notion|slack|github|linear|vercel|heroku|aws|digitalocean|atlassian|jira|hubspot|salesforce|intercom|stripe|twilio|sendgrid|cloudflare)\b", 3, 'Subscriptions'),
    (r"\b(monarch.?money|ynab|mint|copilot.?money|rocket.?money|truebill|personal.?capital|empower.?personal)\b", 4, 'Subscriptions'),
]

RECURRING_HINT_CATEGORIES = [
    'Subscriptions', 'Bills & Utilities', 'Insurance', 'Baby & Kids',
]


# --- fixed / variable ---

FIXED_CATEGORIES = [
    'bills & utilities', 'bills', 'utilities', 'rent', 'mortgage', 'insurance', 'loan payment',
    'debt payment', 'credit card payment', 'subscription', 'subscriptions', 'phone', 'internet', 'cable',
    'housing', 'gym', 'fitness', 'membership', 'streaming', 'auto insurance', 'health insurance',
    'life insurance', 'car payment', 'student loan', 'personal loan', 'auto & transport', 'home',
    'health & fitness', 'personal finance', 'cable & satellite', 'telephone services', 'home improvement',
    'rent & mortgage', 'loans & mortgages', 'rent/mortgage', 'telecommunications',
    'utilities & home services', 'service & parts', 'monthly fees', 'annual fees', 'education', 'childcare',
    'hoa', 'storage', 'parking', 'toll', 'license', 'registration', 'tax',
]

SEMI_FIXED_CATEGORIES = [
    'electric', 'gas', 'water', 'trash', 'sewer',
]

VARIABLE_CATEGORIES = [
    'food & dining', 'groceries', 'shopping', 'entertainment', 'travel', 'personal care', 'health', 'dining',
    'restaurants', 'other', 'miscellaneous', 'fast food', 'coffee shops', 'alcohol & bars', 'arts', 'music',
    'movies & dvds', 'clothing', 'electronics', 'sporting goods', 'hobbies', 'gas & fuel', 'parking',
    'ride share', 'taxi', 'hair & nails', 'spa & massage', 'pharmacy',
]

KEYWORD_FIXED_PATTERNS = [
    r"\bwalmart\+?\s*member\b|\bwmt\s*plus\b|\bwmt\+\b",
    r"\bcostco\s*(?:membership|annual\s*fee|renewal|connect)\b",
    r"\bsam'?s?\s*club\s*(?:membership|annual\s*fee|renewal)\b",
    r"\bbj'?s?\s*(?:wholesale|membership|annual\s*fee)\b",
    r"\b(?:amazon|amzn)\s*prime\b|\bprime\s*membership\b",
    r"\bapple\s*one\b|\bicloud\+?\b",
    r"\btarget\s*circle\s*360\b|\bshipt\s*membership\b",
    r"\b(?:netflix|hulu|disney\+?|hbo\s*max|spotify|youtube\s*premium)\b",
    r"\bapple\.com/bill\b",
]

SUBSCRIPTION_KEYWORDS = [
    'netflix', 'spotify', 'hulu', 'disney', 'apple', 'amazon prime', 'youtube', 'hbo', 'paramount',
    'peacock', 'crunchyroll', 'audible', 'dropbox', 'icloud', 'google one', 'adobe', 'microsoft', 'linkedin',
    'duolingo', 'headspace', 'calm', 'nytimes', 'wsj', 'chatgpt', 'claude', 'runna', 'paddle', 'wmt plus',
    'walmart plus', 'amazon music', 'apple music', 'tidal', 'deezer', 'sirius', 'pandora', 'showtime',
    'starz', 'espn', 'nba league', 'nfl sunday', 'playstation', 'xbox', 'nintendo', 'steam', 'twitch',
    'canva', 'figma', 'notion', 'slack', 'zoom', 'expressvpn', 'nordvpn', 'lastpass', '1password',
]

HARD_FIXED_CATEGORIES = [
    'rent/mortgage', 'rent', 'mortgage', 'rent & mortgage', 'loans & mortgages', 'loan payment',
    'car payment', 'student loan', 'personal loan', 'debt payment', 'insurance', 'auto insurance',
    'health insurance', 'life insurance', 'subscriptions', 'subscription', 'membership', 'bills & utilities',
]


# --- issuers and statement files ---

ISSUER_KEYWORDS = {
    'chase': 'Chase',
    'bank of america': 'Bank of America',
    'bofa': 'Bank of America',
    'bac ': 'Bank of America',
    'american express': 'American Express',
    'amex': 'American Express',
    'capital one': 'Capital One',
    'capitalone': 'Capital One',
    'wells fargo': 'Wells Fargo',
    'wellsfargo': 'Wells Fargo',
    'citibank': 'Citibank',
    'citi bank': 'Citibank',
    'citicards': 'Citibank',
    'discover': 'Discover',
    'us bank': 'US Bank',
    'usbank': 'US Bank',
    'td bank': 'TD Bank',
    'tdbank': 'TD Bank',
    'pnc bank': 'PNC Bank',
    'pnc ': 'PNC Bank',
    'ally bank': 'Ally Bank',
    'ally financial': 'Ally Bank',
    'marcus': 'Marcus by Goldman Sachs',
    'goldman sachs': 'Marcus by Goldman Sachs',
    'apple card': 'Apple Card',
    'sofi': 'SoFi',
    'chime': 'Chime',
    'robinhood': 'Robinhood',
    'schwab': 'Charles Schwab',
    'fidelity': 'Fidelity',
    'navy federal': 'Navy Federal',
    'usaa': 'USAA',
    'regions': 'Regions Bank',
    'suntrust': 'Truist',
    'truist': 'Truist',
    'bbt ': 'Truist',
    'citizens bank': 'Citizens Bank',
    'fifth third': 'Fifth Third Bank',
    'huntington': 'Huntington Bank',
    'keybank': 'KeyBank',
    'comerica': 'Comerica',
    'first republic': 'First Republic',
    'signature bank': 'Signature Bank',
    'synchrony': 'Synchrony Bank',
    'barclays us': 'Barclays US',
}

OFX_INSTITUTIONS = {
    '10898': 'Chase',
    '1001': 'Wells Fargo',
    '1176': 'Bank of America',
    '3101': 'American Express',
    '7000': 'Citibank',
    '815': 'Discover',
    '1461': 'Capital One',
    '5591': 'US Bank',
    '1107': 'TD Bank',
    '2315': 'PNC Bank',
    '3589': 'Ally Bank',
    '101': 'Navy Federal',
    '5163': 'USAA',
}

OFX_TYPES = {
    'debit': 'expense',
    'credit': 'income',
    'int': 'income',
    'div': 'income',
    'fee': 'expense',
    'srvchg': 'expense',
    'dep': 'income',
    'atm': 'expense',
    'pos': 'expense',
    'xfer': 'transfer',
    'check': 'expense',
    'payment': 'credit_card_payment',
    'cash': 'expense',
    'other': 'unknown',
}

POSITIVE_CHARGE_ISSUERS = [
    'American Express', 'Apple Card', 'Citibank', 'Discover', 'Synchrony Bank', 'Barclays US',
]

FEE_KEYWORDS = [
    'pay over time', 'plan it fee', 'installment fee', 'cash advance fee', 'balance transfer fee',
    'late fee', 'foreign transaction fee', 'annual membership fee', 'new pay over time', 'pay over time fee',
]

STATEMENT_SUMMARY_KEYWORDS = [
    'payments/credits', 'payments and credits', 'total payments', 'new balance', 'minimum payment due',
    'payment due', 'statement balance', 'previous balance',
]

STATEMENT_CREDIT_FORMS = [
    'amex.*credit', 'platinum.*credit', 'gold.*credit', 'clear.*plus.*credit', 'amex clear', 'card.*credit',
    'annual.*credit', 'statement credit', 'travel credit', 'digital entertainment credit', 'walmart.*credit',
    'lululemon credit', 'uber cash', 'saks credit', 'cashback', 'cash back reward', 'rewards redemption',
    'reward credit', 'streaming credit', 'hotel credit', 'dining credit', 'clear credit', 'equinox credit',
    'tsa.*credit', 'global entry credit', 'cell phone credit',
]

NON_TRANSACTION_PHRASES = [
    'opening balance', 'closing balance', 'beginning balance', 'ending balance', 'previous balance',
    'new balance', 'available balance', 'current balance', 'minimum payment', 'payment due', 'credit limit',
    'available credit', 'total fees', 'total interest', 'finance charge', 'interest charge',
    'annual percentage', 'billing period', 'statement period', 'account number', 'account summary',
    'transaction summary', 'subtotal', 'total debits', 'total credits', 'total charges',
]

COLUMN_ALIASES = {
    'date': ['date', 'trans date', 'transaction date', 'trans. date', 'posted date', 'settlement date', 'value date', 'effective date'],
    'description': ['description', 'memo', 'narrative', 'merchant', 'payee', 'details', 'transaction description', 'name', 'reference'],
    'amount': ['amount', 'transaction amount', 'net amount', 'sum'],
    'debit': ['debit', 'withdrawal', 'withdrawals', 'debit amount', 'money out', 'charges', 'dr'],
    'credit': ['credit', 'deposit', 'deposits', 'credit amount', 'money in', 'payments', 'cr'],
    'balance': ['balance', 'running balance', 'ledger balance'],
    'category': ['category', 'type', 'transaction type'],
}

SHEET_MARKERS = {
    'American Express': ['platinum card', 'gold card', 'american express', 'amex everyday', 'blue cash'],
    'Chase': ['chase ink', 'chase sapphire', 'chase freedom', 'jpmorgan chase'],
    'Bank of America': ['bank of america', 'bofa'],
    'Wells Fargo': ['wells fargo', 'wellsfargo'],
    'Discover': ['discover it', 'discover card'],
    'Citi': ['citibank', 'citi double cash', 'citi premier'],
}

ISSUER_CATEGORY_MAP = {
    'Food & Drink': 'Food & Dining',
    'Gas': 'Transport',
    'Automotive': 'Transport',
    'Health & Wellness': 'Health',
    'Personal': 'Personal Care',
    'Bills & Utilities': 'Bills & Utilities',
    'Shopping': 'Shopping',
    'Groceries': 'Groceries',
    'Travel': 'Travel',
    'Entertainment': 'Entertainment',
    'Education': 'Education',
    'Professional Services': 'Professional Services',
    'Fees & Adjustments': 'Bank Fees',
    'Gifts & Donations': 'Gifts & Donations',
    'Restaurant-Restaurant': 'Food & Dining',
    'Restaurant-Bar & Cafe': 'Food & Dining',
    'Restaurant-Fast Food': 'Food & Dining',
    'Merchandise & Supplies-Internet Purchase': 'Shopping',
    'Merchandise & Supplies-Department Store': 'Shopping',
    'Merchandise & Supplies-Wholesale Stores': 'Shopping',
    'Merchandise & Supplies-Groceries': 'Groceries',
    'Merchandise & Supplies-Pharmacies': 'Health',
    'Fees & Adjustments-Fees & Adjustments': 'Bank Fees',
    'Transportation-Fuel': 'Transport',
    'Transportation-Auto Services': 'Transport',
    'Transportation-Travel': 'Travel',
    'Transportation-Other Transportation': 'Transport',
    'Travel-Airline': 'Travel',
    'Travel-Lodging': 'Travel',
    'Travel-Other Travel': 'Travel',
    'Entertainment-General Attractions': 'Entertainment',
    'Entertainment-Theatrical Events': 'Entertainment',
    'Communications-Cellular Phone': 'Bills & Utilities',
    'Communications-Cable & Internet Comm': 'Bills & Utilities',
    'Food & Dining': 'Food & Dining',
    'Other': 'Other',
}

CANONICAL_CATEGORIES = [
    'Food & Dining', 'Groceries', 'Transport', 'Bills & Utilities', 'Subscriptions', 'Health', 'Shopping',
    'Entertainment', 'Travel', 'Personal Care', 'Pets', 'Education', 'Loan Payment', 'Credit Card Payment',
    'Refund', 'Salary', 'Transfer', 'Other', 'Baby & Kids', 'Bank Fees', 'Card Credit', 'Cash & ATM',
    'Gifts & Donations', 'Government & Taxes', 'Home Improvement', 'Insurance', 'Professional Services',
]

PARSE_THRESHOLDS = {
    'template': 0.9,
    'generic_table': 0.8,
    'generic_text': 0.75,
    'ocr': 0.65,
}

LAYOUT_SKIP_SECTIONS = [
    'payments and credits', 'new charges', 'summary', 'detail', 'continued on', 'account ending',
    'closing date', 'customer care', 'total payments', 'total new charges', 'minimum payment',
    'please detach', 'payment coupon', 'amount due',
]


# --- extraction review ---

EXTRACTION_CATEGORIES = [
    'Rent/Mortgage', 'Food & Dining', 'Groceries', 'Transport', 'Bills & Utilities', 'Subscriptions',
    'Health', 'Shopping', 'Entertainment', 'Travel', 'Personal Care', 'Pets', 'Education', 'Salary',
    'Other Income', 'Transfer', 'Credit Card Payment', 'Loan Payment', 'Refund', 'Other', 'Alcohol & Liquor',
    'Baby & Kids', 'Bank Fees', 'Card Credit', 'Cash & ATM', 'Gifts & Donations', 'Government & Taxes',
    'Home Improvement', 'Insurance', 'Professional Services',
]

SIGN_TRAP_WORDS = [
    'refund', 'return', 'payment', 'credit', 'reversal', 'adjustment', 'cashback', 'cash back', 'thank you',
]


# --- card credits ---

CREDIT_INELIGIBLE_PATTERN = r"\b(cashback|cash.?back.?reward|welcome.?bonus|sign.?up.?bonus|points.?redemption|reward.?redemption|annual.?bonus|referral.?bonus|promotional.?credit|courtesy.?credit)\b"

CREDIT_PROGRAMS = {
    'platinum dining': ('Food & Dining', 'flexible', 'high'),
    'platinum travel': ('Travel', 'flexible', 'high'),
    'platinum uber': ('Subscriptions', 'committed', 'high'),
    'platinum walmart': ('Subscriptions', 'committed', 'high'),
    'platinum digital': ('Subscriptions', 'committed', 'high'),
    'platinum entertainment': ('Subscriptions', 'committed', 'high'),
    'platinum streaming': ('Subscriptions', 'committed', 'high'),
    'platinum lululemon': ('Shopping', 'flexible', 'high'),
    'platinum saks': ('Shopping', 'flexible', 'high'),
    'platinum equinox': ('Health', 'flexible', 'high'),
    'platinum hotel': ('Travel', 'flexible', 'high'),
    'platinum airline': ('Travel', 'flexible', 'high'),
    'platinum clear': ('Subscriptions', 'committed', 'high'),
    'platinum resy': ('Food & Dining', 'flexible', 'high'),
    'platinum grubhub': ('Food & Dining', 'flexible', 'high'),
    'platinum doordash': ('Food & Dining', 'flexible', 'high'),
    'platinum dunkin': ('Food & Dining', 'flexible', 'high'),
    'platinum shake shack': ('Food & Dining', 'flexible', 'high'),
    'platinum cell phone': ('Bills & Utilities', 'committed', 'high'),
    'gold dining': ('Food & Dining', 'flexible', 'high'),
    'gold uber cash': ('Food & Dining', 'flexible', 'high'),
    'gold grocery': ('Groceries', 'flexible', 'high'),
    'amex clear': ('Subscriptions', 'committed', 'high'),
}

CREDIT_TYPE_PATTERNS = [
    (r"\b(dining|restaurant|food|grubhub|doordash|uber.?eats)\b", 'dining', 'Food & Dining', 'flexible'),
    (r"\b(travel|airline|hotel|resort|airbnb|delta|united|marriott|hilton|hyatt|global.?entry|tsa)\b", 'travel', 'Travel', 'flexible'),
    (r"\b(digital.?entertainment|streaming|netflix|spotify|hulu|disney|apple.?tv|youtube|entertainment)\b", 'subscription', 'Subscriptions', 'committed'),
    (r"\b(uber.?one|walmart.?plus|wmt.?plus|clearme|clear.?plus|amazon.?prime|audible)\b", 'subscription', 'Subscriptions', 'committed'),
    (r"\b(utility|electric|internet|phone|wireless|att|verizon|cell.?phone)\b", 'bill', 'Bills & Utilities', 'committed'),
    (r"\b(lululemon|saks|neiman|nordstrom|shopping)\b", 'shopping', 'Shopping', 'flexible'),
    (r"\b(equinox|gym|fitness|peloton|health)\b", 'health', 'Health', 'flexible'),
    (r"\b(cashback|cash.?back|reward|points|bonus|statement.?credit)\b", 'cashback', None, None),
]

CREDIT_INLINE_HINTS = {
    'walmart': 'wmt',
    'uber one': 'uber one',
    'lululemon': 'lululemon',
    'hulu': 'hulu',
    'youtube': 'youtube',
    'clear': 'clearme',
    'disney': 'disney',
    'netflix': 'netflix',
    'spotify': 'spotify',
    'doordash': 'doordash',
    'grubhub': 'grubhub',
    'resy': 'resy',
    'saks': 'saks',
    'equinox': 'equinox',
}


# --- analyses and insights ---

DISCRETIONARY_CATEGORIES = [
    'Food & Dining', 'Shopping', 'Entertainment', 'Personal Care', 'Alcohol & Liquor', 'Travel',
    'Gifts & Donations', 'Subscriptions',
]

TRIMMABLE_CATEGORIES = [
    'Food & Dining', 'Shopping', 'Subscriptions', 'Entertainment', 'Alcohol & Liquor', 'Personal Care',
]

OBLIGATION_CATEGORIES = [
    'Rent/Mortgage', 'Loan Payment', 'Insurance', 'Bills & Utilities', 'Credit Card Payment', 'Education',
    'Government & Taxes',
]

INSIGHT_SUBSCRIPTION_KEYWORDS = [
    'netflix', 'spotify', 'hulu', 'disney', 'apple', 'youtube', 'hbo', 'paramount', 'peacock',
    'amazon prime', 'audible', 'dropbox', 'icloud', 'adobe', 'microsoft', 'google one', 'runna', 'paddle',
    'wmt plus', 'walmart plus',
]

SUBSCRIPTION_BUNDLES = [
    (['spotify', 'apple music', 'youtube music', 'tidal'], 'music streaming', 'You only need one music service'),
    (['netflix', 'hulu', 'disney', 'hbo', 'paramount', 'peacock'], 'video streaming', 'Disney Bundle covers Disney+, Hulu and ESPN+ for $13.99/mo'),
    (['spotify', 'apple'], 'Apple One bundle', 'Apple One includes Apple Music, TV+, Arcade and iCloud'),
    (['youtube', 'spotify'], 'YouTube Premium', 'YouTube Premium includes YouTube Music — Spotify may be redundant'),
]

"""Words by which messages are understood: a small default, and the reading of a larger one.

The default is enough for everyday requests in English, Hindi and Telugu. A fuller lexicon is a JSON file with the same
sections, given as a parameter: {"doc_types": {"PAN": ["pan card", ...]}, "intent_words": {...}, ...}.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field, fields

from pyspark.sql import SparkSession

Terms = dict[str, list[str]]


def _terms(**sections: str) -> Terms:
    """Terms parted by commas."""
    return {k: [t.strip() for t in v.split(",")] for k, v in sections.items()}


# Terms for document types.
DOC_TYPES = _terms(
    AADHAAR="aadhaar, aadhar, aadhaar card, uid, आधार, आधार कार्ड, ఆధార్",
    PAN="pan, pan card, पैन, పాన్",
    DRIVING_LICENCE="driving licence, driving license, licence, license, dl, लाइसेंस, లైసెన్స్",
    VEHICLE_RC="rc, rc book, registration certificate, vehicle registration, गाड़ी के कागज, బండి కాగితాలు",
    PASSPORT="passport, पासपोर्ट, పాస్‌పోర్ట్, పాస్పోర్ట్",
    VOTER_ID="voter id, voter card, election card, मतदाता पहचान पत्र, ఓటరు కార్డు",
    HEALTH_ID_ABHA="abha, health id, ayushman, आभा, ఆభా",
    HEALTH_INSURANCE="health insurance, mediclaim, medical insurance, health policy, insurance, bima, बीमा, బీమా, ఇన్సూరెన్స్",
    VEHICLE_INSURANCE="car insurance, bike insurance, vehicle insurance, motor insurance, वाहन बीमा, गाड़ी का बीमा, వాహన బీమా, కారు ఇన్సూరెన్స్",
    LIFE_INSURANCE="life insurance, lic, term insurance, जीवन बीमा, జీవిత బీమా",
    SALARY_SLIP="salary, salary slip, salary slips, payslip, pay slip, jeetham, vetan, tankha, वेतन, सैलरी, జీతం, జీతం స్లిప్, వేతనం",
    BANK_STATEMENT="bank statement, statement, account statement, passbook, bank, बैंक, बैंक स्टेटमेंट, బ్యాంక్",
    RESUME="resume, cv, curriculum vitae, biodata, बायोडाटा, బయోడేటా",
    EMPLOYMENT_LETTER="offer letter, appointment letter, employment letter, experience letter, नियुक्ति पत्र, ऑफर लेटर, ఆఫర్ లెటర్",
    ITR_FORM16="itr, form 16, form16, income tax return, tax return, आयकर रिटर्न, ఫారం 16",
    RENT_AGREEMENT="rent agreement, rental agreement, lease, kiraya, किराया, అద్దె ఒప్పందం",
    PROPERTY_PAPER="property, sale deed, house papers, land papers, patta, संपत्ति, పట్టా",
    LOAN_SANCTION_EMI="sanction letter, emi, loan statement, repayment schedule, किस्त, వాయిదా",
    MEDICAL_REPORT="medical report, lab report, blood test, test report, report, reports, x-ray, मेडिकल रिपोर्ट, रिपोर्ट, రిపోర్ట్",
    HOSPITAL_BILL="hospital bill, hospital bills, medical bill, discharge bill, अस्पताल का बिल, హాస్పిటల్ బిల్లు, ఆసుపత్రి బిల్లు",
    PRESCRIPTION="prescription, medicines, पर्ची, మందుల చీటీ",
    UTILITY_BILL="electricity bill, current bill, power bill, water bill, gas bill, broadband bill, बिजली बिल, కరెంట్ బిల్లు",
    RECEIPT_INVOICE="invoice, receipt, receipts, bill, bills, रसीद, రశీదు",
    PAYMENT_SCREENSHOT="payment screenshot, upi, transaction, payment, भुगतान, చెల్లింపు",
    WARRANTY="warranty, guarantee, वारंटी, వారంటీ",
    TICKET="ticket, tickets, pnr, boarding pass, टिकट, టికెట్",
)
# Terms for tasks, for kinds of requests, for small talk and photos.
TEMPLATES = _terms(
    home_loan="home loan, housing loan, loan, होम लोन, लोन, హోమ్ లోన్, లోన్",
    health_insurance_claim="claim, insurance claim, cashless, reimbursement, क्लेम, క్లెయిమ్",
    vehicle_insurance_renewal="car insurance renewal, renew car insurance, bike insurance renewal, vehicle insurance renewal",
    passport="apply passport, passport application, new passport, passport renewal",
)
INTENTS = _terms(
    pack="ready, prepare, checklist, documents for, papers for, needed for, kavali, chahiye, चाहिए, కావాలి",
    reminders="expire, expires, expiry, expiring, expired, renewal, renew, due, valid till, समाप्त, గడువు",
    question="what is, what's, how much, which, when, number, amount, kya hai, kitna, kab, enti, entha, eppudu, ekkada, कितना, कब, ఎంత, ఎప్పుడు",
)
CHAT = _terms(
    greeting="hi, hello, hey, good morning, good evening, namaste, how are you, kaise ho, ela unnavu, नमस्ते, హాయ్, నమస్కారం",
    thanks="thanks, thank you, ok, okay, great, yes, yeah, sure, dhanyavad, धन्यवाद, ధన్యవాదాలు, సరే",
    help="help, what can you do, who are you, how does this work, features, मदद, సహాయం",
    bye="bye, goodbye, see you, अलविदा, సెలవు",
    privacy="is my data safe, is it safe, privacy, private, offline, internet, cloud, can you see my, secure, encrypted, सुरक्षित, సురక్షితం",
    offtopic="weather, joke, news, cricket, movie, song, recipe, python, java, code, poem, story, translate, मौसम, వాతావరణం",
)
PHOTOS = _terms(
    SCREENSHOT="screenshot, screenshots, screen shot, स्क्रीनशॉट, స్క్రీన్ షాట్",
    SELFIE="selfie, selfies, सेल्फी, సెల్ఫీ",
    PEOPLE="people, group photo, friends, family photos, with friends, दोस्त, స్నేహితులు",
    FOOD="food, food photos, meal, lunch photos, खाना, భోజనం, ఫుడ్",
    PLACES="trip, trips, travel, vacation, holiday photos, tour, places, यात्रा, ट्रिप, ట్రిప్, ప్రయాణం",
)
# Terms for corrections, negations, actions, order, overviews and what points back at a reply.
CORRECTIONS = _terms(correction="wrong one, this is wrong, that's wrong, not this one, not this, none of these, not correct, incorrect, wrong document, not what i asked, this isn't it, that's not it, this is not the, that is not the, that's not the, this isn't the, galat hai, यह गलत है, गलत है, ఇది తప్పు, ఇది కాదు")
NEGATIONS = _terms(before="not, except, excluding, exclude, other than, apart from, without, besides, don't want", after="nahi, ke alawa, chhodkar, kakunda, tappa, vaddu, नहीं, के अलावा, छोड़कर, కాకుండా, తప్ప, వద్దు")
ACTIONS = _terms(
    share="share, send, forward, email, mail it, whatsapp, as pdf, pdf, bhejo, pampu, भेजो, పంపు",
    delete="delete, remove, erase, get rid of, hatao, हटाओ, తొలగించు",
    edit="rename, edit, change the name, change type, modify, नाम बदलो, పేరు మార్చు",
    advice="how to, how do i, how can i, what should i do, i lost, lost my, apply for, get a new, duplicate, reissue, ela apply",
)
ORDERS = _terms(oldest="oldest, earliest, my first, very first, purana, पुराना, పాత, మొదటి")
OVERVIEWS = _terms(all="all documents, all my documents, all files, everything, what documents, which documents, what do you have, my documents, my files, show all, list all, सब दस्तावेज़, అన్ని పత్రాలు")
FOLLOW_UPS = _terms(
    reference="it, its, that, this, those, these, them, same, that one, this one, the one, above, यह, वह, అది, ఇది",
    attribute="when, expire, expires, expiry, valid, number, amount, date, issued, how much, total, what is, details, whose, address, कब, कितना, ఎప్పుడు, ఎంత",
    older="older, previous, earlier one, another, other one, different one, next one, one more, more, next, दूसरा, और, మరొకటి",
    owner_switch="and my, what about, how about, and for, same for, for my, और मेरा",
    first="first one, the first, 1st, top one, पहला, మొదటిది",
    second="second one, the second, second, 2nd",
    third="third one, the third, third, 3rd",
    last="last one, the last one, bottom one, आखिरी, చివరిది",
)
PERIODS = _terms(
    this_month="this month, is mahine, ee nela, इस महीने, ఈ నెల",
    last_month="last month, previous month, pichle mahine, gata nela, पिछले महीने, గత నెల",
    last_3_months="last three months, last 3 months, past three months, पिछले तीन महीने, గత మూడు నెలలు",
    last_6_months="last six months, last 6 months, past six months, पिछले छह महीने, గత ఆరు నెలలు",
    this_year="this year, is saal, इस साल, ఈ సంవత్సరం",
    last_year="last year, pichle saal, पिछले साल, గత సంవత్సరం",
)
# Latin-script words that hint at a language, with weights.
HINTS = {
    "te": {"cheyyi": 3, "chupinchu": 3, "kavali": 2, "ekkada": 2, "undi": 1.5, "unnayi": 2, "enti": 2, "entha": 2, "eppudu": 2, "naa": 1, "nenu": 2, "lo": 0.5, "ivvu": 2, "gaduvu": 2, "jeetham": 2, "nela": 1.5},
    "hi": {"karo": 2, "chahiye": 2, "dikhao": 3, "batao": 3, "kahan": 2, "hai": 1, "mera": 1.5, "meri": 1.5, "mere": 1.5, "kitna": 2, "kya": 1.5, "ka": 0.5, "ki": 0.5, "ke": 0.5, "mahine": 2, "pichle": 2},
}


@dataclass
class Lexicon:
    doc_types: Terms = field(default_factory=lambda: DOC_TYPES)
    templates: Terms = field(default_factory=lambda: TEMPLATES)
    intent_words: Terms = field(default_factory=lambda: INTENTS)
    language_hints: dict[str, dict[str, float]] = field(default_factory=lambda: HINTS)
    relative_dates: Terms = field(default_factory=lambda: PERIODS)
    chat_words: Terms = field(default_factory=lambda: CHAT)
    photo_categories: Terms = field(default_factory=lambda: PHOTOS)
    correction_words: Terms = field(default_factory=lambda: CORRECTIONS)
    negation_words: Terms = field(default_factory=lambda: NEGATIONS)
    action_words: Terms = field(default_factory=lambda: ACTIONS)
    order_words: Terms = field(default_factory=lambda: ORDERS)
    overview_words: Terms = field(default_factory=lambda: OVERVIEWS)
    follow_up_words: Terms = field(default_factory=lambda: FOLLOW_UPS)


def parse(text: str) -> Lexicon:
    """A lexicon from JSON; sections that are missing are empty, others unknown are ignored."""
    given = json.loads(text)
    return Lexicon(**{f.name: given.get(f.name, {}) for f in fields(Lexicon)})


def read(spark: SparkSession, path: str) -> Lexicon:
    """A lexicon from a JSON file in any store that Spark reads: a dictionary of some kilobytes."""
    return parse("".join(r[0] for r in spark.read.text(path, wholetext=True).collect()))

"""Terms that point to a business domain."""

# The domains and their terms, in the order that breaks ties.
DOMAIN_TERMS: dict[str, tuple[str, ...]] = {
    "Financial Services / Credit Card": (
        "transaction", "amount", "merchant", "credit", "debit", "balance", "limit", "account",
        "card", "payment", "fraud", "charge", "fee", "interest", "loan", "bank", "currency",
        "exchange", "transfer", "statement", "billing",
    ),
    "E-commerce / Retail": (
        "order", "product", "quantity", "price", "sku", "cart", "basket", "shipping", "delivery",
        "refund", "return", "discount", "coupon", "inventory", "stock", "catalogue", "catalog",
        "vendor", "supplier", "purchase", "sale", "unit", "item",
    ),
    "Healthcare": (
        "patient", "diagnosis", "icd", "admission", "discharge", "medication", "prescription",
        "dosage", "symptom", "condition", "procedure", "doctor", "physician", "nurse", "hospital",
        "clinic", "lab", "test", "result", "vital", "blood", "weight", "height", "bmi",
        "insurance", "claim", "treatment",
    ),
    "HR / People Analytics": (
        "employee", "staff", "headcount", "department", "salary", "wage", "bonus", "hire",
        "termination", "tenure", "performance", "rating", "review", "leave", "absence",
        "overtime", "payroll", "benefit", "role", "title", "manager", "team", "attrition",
        "retention", "recruitment", "onboard",
    ),
    "Marketing / CRM": (
        "campaign", "lead", "conversion", "impression", "click", "ctr", "cpc", "cpm", "roas",
        "channel", "source", "medium", "utm", "email", "open", "bounce", "unsubscribe", "segment",
        "cohort", "lifetime", "ltv", "churn", "nps", "satisfaction", "survey", "customer",
        "contact", "prospect",
    ),
    "SaaS / Product Analytics": (
        "user", "session", "event", "pageview", "feature", "subscription", "plan", "trial", "mrr",
        "arr", "churn", "dau", "mau", "wau", "retention", "activation", "engagement", "funnel",
        "onboard", "login", "signup", "install", "device", "platform", "version",
    ),
    "Logistics / Supply Chain": (
        "shipment", "freight", "carrier", "route", "warehouse", "location", "origin",
        "destination", "weight", "volume", "tracking", "status", "dispatch", "transit", "delay",
        "eta", "lead_time", "reorder", "supplier", "vendor", "po", "invoice", "customs",
    ),
    "Real Estate": (
        "property", "listing", "price", "sqft", "bedroom", "bathroom", "zip", "zipcode",
        "postcode", "neighborhood", "city", "address", "rent", "mortgage", "appraisal", "agent",
        "broker", "lease", "vacancy", "occupancy",
    ),
}

"""Controlled vocabularies and word lists.

Fixed values: each table below is data that results depend on, not logic.
"""

from __future__ import annotations

# Fixed value: the time zone reports are shown in.
DISPLAY_TZ = "Africa/Tunis"

# Sentiment classes and names of week days, in order.
SENTIMENTS = ("positive", "neutral", "negative")
DAY_NAMES = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")

# Platform-native content type -> canonical content type.
CONTENT_TYPE_MAP = {
    "photo": "photo", "photos": "photo", "image": "photo",
    "video": "video", "reels": "reel", "reel": "reel",
    "album": "carousel", "carousel": "carousel", "carousel_album": "carousel",
    "status": "text", "text": "text", "link": "link", "shared_link": "link",
    "IMAGE": "photo", "VIDEO": "video", "CAROUSEL_ALBUM": "carousel",
    "youtube#video": "video", "short": "short", "shorts": "short",
}

# Page post status -> content type, before the mapping above.
PAGE_STATUS_MAP = {
    "added_photos": "photo", "added_video": "video", "shared_story": "link",
    "mobile_status_update": "text", "published_story": "text", "created_note": "text",
}

# Insight series name per snapshot column.
INSIGHT_NAMES = {
    "impressions": "post_impressions",
    "reach": "post_impressions_unique",
    "clicks": "post_clicks",
}

# Fixed value: the longest video that counts as a short one.
SHORT_MAX_SECONDS = 60

# Class names a sentiment model may answer with.
MODEL_LABELS = {
    "negative": "negative", "neg": "negative", "label_0": "negative",
    "neutral": "neutral", "neu": "neutral", "label_1": "neutral",
    "positive": "positive", "pos": "positive", "label_2": "positive",
}

# Label spellings found in labelled data sets.
DATASET_LABELS = {
    "positive": "positive", "pos": "positive", "p": "positive", "1": "positive",
    "negative": "negative", "neg": "negative", "n": "negative", "0": "negative", "-1": "negative",
    "neutral": "neutral", "neu": "neutral", "mixed": "neutral", "2": "neutral",
}

# Emoji polarity.
EMOJI_POSITIVE = "😀😁😂🤣😊😍🥰😘👍👏🙏❤💕💚🔥🎉✨😎🥳💯😇🤩"
EMOJI_NEUTRAL = "😐😶🤔😴🙂"
EMOJI_NEGATIVE = "😞😔😢😭😠😡🤬👎💔🤮😤😩😒🙄😳"

# Arabic letter variants and the letter each is unified to, position by position.
ARABIC_FROM = "أإآٱىئؤة"
ARABIC_TO = "ااااييوه"

# Tunisian dialect words in Latin letters.
TUNISIAN_WORDS = (
    "barcha", "barsha", "yesser", "behi", "bahi", "sa7a", "sahha", "3aslema", "aslema",
    "inshallah", "nchallah", "ychallah", "ya3tik", "yaatik", "mte3", "mtaa", "famma", "fama",
    "chnowa", "chnia", "3andi", "3andek", "mouch", "mch", "mech", "nheb", "n7eb", "brabbi",
    "3la", "3ala", "w9tach", "waqtach", "chwaya", "barka", "labes", "labas", "sahbi", "7aja",
    "kifach", "bech", "besh", "5ir", "khir", "mabrouk", "3aychek", "aychek", "tbarkallah",
    "3aslama", "yezzi", "3adi", "9alb", "9added", "wenou", "3avec", "taw", "tawa", "hedha",
    "hetha", "familia", "semhili", "3achra", "mrigel", "zeda", "zada",
)

# Hint words per language.
FRENCH_HINTS = (
    "le", "la", "les", "je", "tu", "est", "une", "des", "pas", "tres", "merci", "bonjour",
    "produit", "livraison", "trop", "bien", "vraiment", "avec", "pour", "vous", "nous",
    "recommande", "qualite", "commande", "super",
)
ENGLISH_HINTS = (
    "the", "you", "this", "that", "great", "good", "bad", "love", "hate", "price", "quality",
    "order", "again", "worth", "amazing", "thanks", "please", "very", "will", "not", "really",
    "delivery", "product",
)
FRENCH_ACCENTS = "éèêàâçùûîïôœÉÈÊÀÂÇÙÛÎÏÔŒ"

# Words the lexicon sentiment backend scores; our own short lists.
POSITIVE_WORDS = (
    "great", "good", "love", "amazing", "thanks", "worth", "super", "merci", "bien",
    "recommande", "behi", "bahi", "sa7a", "mabrouk", "mrigel", "رائع", "شكرا",
)
NEGATIVE_WORDS = (
    "bad", "hate", "awful", "terrible", "slow", "nul", "déçu", "mauvais", "mouch", "m3atla",
    "yezzi", "سيء",
)

# Candidate export headers per canonical field, first present one wins.
CSV_PROFILES = {
    "meta_business_suite_posts": {
        "platform": "facebook",
        "required": ("external_id", "published_at"),
        "columns": {
            "external_id": ("Post ID", "post_id", "Publication ID"),
            "account_external_id": ("Page ID", "page_id", "Account ID"),
            "account_handle": ("Page username", "Username"),
            "account_name": ("Page name", "page_name", "Account name"),
            "published_at": ("Publish time", "Time", "Date", "Publication time"),
            "content_type": ("Post type", "Type", "Media type"),
            "text_content": ("Title", "Description", "Message", "Caption"),
            "permalink": ("Permalink", "Link", "Post link", "URL"),
            "likes": ("Reactions", "Likes", "Like reactions", "Total reactions"),
            "comments_count": ("Comments", "Comment count"),
            "shares": ("Shares", "Share count"),
            "saves": ("Saves", "Saved"),
            "reach": ("Reach", "Post reach", "Accounts reached"),
            "impressions": ("Impressions", "Post impressions"),
            "video_views": ("Video views", "3-second video views", "Plays"),
            "clicks": ("Link clicks", "Clicks", "Post clicks"),
        },
    },
    "meta_business_suite_ig_posts": {
        "platform": "instagram",
        "required": ("external_id", "published_at"),
        "columns": {
            "external_id": ("Post ID", "Media ID", "id"),
            "account_external_id": ("Account ID", "IG User ID", "Page ID"),
            "account_handle": ("Username", "Handle"),
            "account_name": ("Account name", "Name"),
            "published_at": ("Publish time", "Time", "Timestamp"),
            "content_type": ("Media type", "Post type", "Type"),
            "text_content": ("Caption", "Description", "Title"),
            "permalink": ("Permalink", "Link", "URL"),
            "likes": ("Likes", "Reactions"),
            "comments_count": ("Comments", "Comment count"),
            "shares": ("Shares",),
            "saves": ("Saves", "Saved"),
            "reach": ("Reach", "Accounts reached"),
            "impressions": ("Impressions",),
            "video_views": ("Video views", "Plays", "Reels plays"),
            "clicks": ("Website clicks", "Link clicks", "Clicks"),
        },
    },
    "kaggle_engagement_generic": {
        "platform": None,
        "required": ("published_at",),
        "columns": {
            "external_id": ("post_id", "id", "Post ID"),
            "account_external_id": ("account_id", "user_id", "page_id"),
            "account_handle": ("username", "handle", "account"),
            "account_name": ("account_name", "name"),
            "published_at": ("timestamp", "date", "published_at", "post_time"),
            "content_type": ("type", "media_type", "content_type"),
            "text_content": ("text", "caption", "content", "message"),
            "permalink": ("url", "permalink", "link"),
            "likes": ("likes", "like_count", "reactions"),
            "comments_count": ("comments", "comment_count", "num_comments"),
            "shares": ("shares", "share_count", "retweets"),
            "saves": ("saves", "bookmarks"),
            "reach": ("reach",),
            "impressions": ("impressions", "views"),
            "video_views": ("video_views", "plays"),
            "clicks": ("clicks", "link_clicks"),
        },
    },
}
DEFAULT_CSV_PROFILE = "meta_business_suite_posts"

# Character ranges of the text operators.
ZERO_WIDTH_RANGE = r"[\x{200b}-\x{200f}\x{202a}-\x{202e}\x{2066}-\x{2069}\x{feff}]"
DIACRITICS_RANGE = r"[\x{64b}-\x{652}\x{670}\x{640}]"
EMOJI_RANGE = r"[\x{1f300}-\x{1faff}\x{2600}-\x{27bf}\x{1f000}-\x{1f0ff}]"
ARABIC_RANGE = r"\x{600}-\x{6ff}\x{750}-\x{77f}\x{8a0}-\x{8ff}"
INTRAWORD_DIGITS = "[a-z][235679]|[235679][a-z]"

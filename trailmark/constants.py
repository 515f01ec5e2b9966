"""Fixed values of the trace domain: names, lists and patterns that results depend on."""

# fixed values: base event -> capability
CAPABILITY_OF = {
    "XHR Request": "NET_XHR", "XHR Response": "NET_XHR",
    "Fetch Request": "NET_FETCH", "Fetch Response": "NET_FETCH",
    "Beacon API Call": "NET_BEACON",
    "Cache API Open": "CACHE", "Cache API Match": "CACHE",
    "Storage Event": "STORAGE",
    "WebSocket Connection": "NET_WS", "WebSocket Send": "NET_WS",
    "WebSocket Receive (onmessage)": "NET_WS", "WebSocket Receive (addEventListener)": "NET_WS",
    "Redirect via location.href": "REDIRECT", "Redirect via location.replace": "REDIRECT", "Redirect via location.assign": "REDIRECT",
    "Popup Opened": "POPUP", "Fullscreen Requested": "POPUP", "Window Blur (Possible Popup)": "POPUP",
    "Script Src Set": "DOM_INJECT_SCRIPT", "Inline Script Injected": "DOM_INJECT_SCRIPT",
    "Document.write Call": "DOM_INJECT_HTML", "Document.writeln Call": "DOM_INJECT_HTML", "HTML Property Write (Suspicious)": "DOM_INJECT_HTML",
    "IFrame Src Set": "DOM_INJECT_IFRAME", "IFrame Created (Potential Context Escape)": "DOM_INJECT_IFRAME",
    "WARNING: Multiple IFrames Created": "HOOK_EVASION", "Hook Detection Attempt": "HOOK_EVASION",
    "Form Submitted": "CREDENTIALS", "Sensitive Field Read": "CREDENTIALS", "Sensitive Field Write": "CREDENTIALS",
    "Suspicious querySelector": "CREDENTIALS", "Suspicious getElementById": "CREDENTIALS",
    "Cookie Read": "COOKIE", "Cookie Update": "COOKIE",
    "Clipboard Read": "CLIPBOARD", "Clipboard Write": "CLIPBOARD",
    "Service Worker Registration": "SERVICE_WORKER",
    "Web Worker Created": "WORKER",
    "Blob URL Created": "BLOB",
    "Download Triggered": "DOWNLOAD",
    "Object.defineProperty Called": "HOOKING",
    "Eval Call": "OBFUSCATION", "Function Constructor": "OBFUSCATION", "atob De-obfuscation": "OBFUSCATION",
    "String.fromCharCode De-obfuscation": "OBFUSCATION", "JSON.parse Suspicious Payload": "OBFUSCATION",
    "WebGL Context Creation": "FINGERPRINTING", "Canvas toDataURL": "FINGERPRINTING",
    "PushManager Subscribe": "PUSH", "Notification Request Permission": "PUSH",
    "Alert Dialog": "SOCIAL_ENGINEERING", "Confirm Dialog": "SOCIAL_ENGINEERING", "Prompt Dialog": "SOCIAL_ENGINEERING",
    "MutationObserver (Native)": "DOM_MUTATION",
}

# fixed values: base events with weight 2
SUSPICIOUS = (
    "Cookie Read", "Cookie Update", "Script Src Set", "Inline Script Injected", "HTML Property Write (Suspicious)",
    "Document.write Call", "Document.writeln Call", "Eval Call", "Function Constructor", "atob De-obfuscation",
    "String.fromCharCode De-obfuscation", "JSON.parse Suspicious Payload", "Redirect via location.href",
    "Redirect via location.replace", "Redirect via location.assign", "Sensitive Field Read", "Sensitive Field Write",
    "Form Submitted", "Clipboard Read", "Clipboard Write", "Hook Detection Attempt", "Service Worker Registration",
    "Web Worker Created", "Blob URL Created", "IFrame Src Set", "IFrame Created (Potential Context Escape)",
    "WARNING: Multiple IFrames Created", "MutationObserver (Native)", "Sensitive Field Access", "Document Fragment Injection",
)

# fixed values: events that are noise, and stacks of the monitor itself
NOISE = ("Monitoring Started", "Monitoring Script Fully Loaded")
MONITOR_STACKS = ("dom_mutation_observer.js", "monitoring.js", "mutation_observers")

# fixed values: domain suffixes
AD_SUFFIXES = ("doubleclick.net", "googlesyndication.com", "googleadservices.com", "adservice.google.com", "adnxs.com", "taboola.com", "outbrain.com", "criteo.com", "scorecardresearch.com")
ANALYTICS_SUFFIXES = ("google-analytics.com", "googletagmanager.com", "googletagservices.com", "facebook.net", "mixpanel.com", "segment.com", "snowplowanalytics.com")

# fixed values: base events whose token describes a request
NETWORK_EVENTS = (
    "XHR Request", "XHR Response", "Fetch Request", "Fetch Response", "Beacon API Call", "WebSocket Connection", "WebSocket Send",
    "WebSocket Receive (onmessage)", "WebSocket Receive (addEventListener)", "Network.requestWillBeSent", "Network.responseReceived",
    "networkRequest", "Script Src Set", "IFrame Src Set", "Image Src Set", "Link Href Set", "Form Submitted",
)

# fixed values: cookies
COOKIE_ATTRIBUTES = ("domain", "path", "expires", "max-age", "maxage", "samesite", "priority", "secure", "httponly")
COOKIE_FLAGS = ("secure", "httponly")

# fixed values: query keys of asset versions, by priority; keys that may hold a URL, by priority
VERSION_KEYS = ("ver", "version", "ao_version", "v", "wpv", "tver", "plugin_ver")
URL_KEYS = ("url", "requestUrl", "documentURL", "src", "href", "location", "action", "scriptURL")

# fixed values: parts of a token that are matched softly
WEAK_PREFIXES = ("weak_host=", "weak_path=", "weak_domain=")

# fixed values: hosting platforms that are left out of coverage counts
HOSTED_PLATFORMS = ("blogspot.com", "wordpress.com", "github.io", "netlify.app", "vercel.app", "wixsite.com")

# fixed values: keyword lists of the detectors
C2_HOSTS = ("indejs", "selectblackrouls", "collect-v6.51", "collect-v6", "51.la")
CDN_HOSTS = ("cdn.jsdelivr", "cdnjs.cloudflare", "unpkg.com", "ajax.googleapis", "static.cloudflare", "cloudflare.com")
WORKER_QUEUES = ("wpTestEmojiSupports",)
BEACON_COOKIES = ("__51", "__vt", "ibx_", "__vtins", "__51v")
BENIGN_STACKS = ("react-dom", "webpack", "jquery", "vue.runtime", "angular", "svelte", "/node_modules/")
PROBED = ("navigator.webdriver", "navigator.plugins", "navigator.mimetypes", "navigator.languages", "navigator.hardwareconcurrency", "window.chrome")
PLATFORM_PROBES = ("ontouchstart", "orientation", "screen.width", "screen.height", "maxtouchpoints")
WEB3_WORDS = ("web3", "binance", "metamask", "walletconnect", "ethers")
PATCH_TARGETS = ("globalthis", "reflect", "symbol", "promise", "weakmap", "weakset", "map", "set", "aggregateerror", "navigator", "document")

# fixed values: capabilities that make a trace suspicious beside its events
HIGH_RISK = (
    "DOM_INJECT_SCRIPT", "DOM_INJECT_IFRAME", "DOM_INJECT_HTML", "DOM_INJECT_CSS", "DOM_INJECT_NODE", "DOM_INJECT_STYLE", "DOM_INJECT_WORKER",
    "DOM_INJECT_IMAGE", "DOM_INJECT_SOURCE", "DOM_INJECT_EVENT", "DOM_INJECT_PROP", "DOM_INJECT_STORAGE", "NET_XHR", "NET_FETCH", "NET_SOCKET",
    "NET_BEACON", "NET_WEBSOCKET", "NET_WEBRTC", "NET_REQUEST", "OBFUSCATION", "FINGERPRINTING", "CLIPBOARD", "WORKLET", "WORKER", "BLOB",
)

# fixed values: what raises a trace's score
SCORE_WORDS = ("atob", "btoa", "fromcharcode", "function constructor", "function(", "eval", "unescape", "document.write", "settimeout (string", "setinterval (string", "script element injected")
SCORE_CAPABILITIES = ("OBFUSCATION", "DOM_INJECT_HTML", "DOM_MUTATION", "HOOKING")
REQUEST_BASES = ("fetch request", "xhr request", "networkrequest", "beacon api call")
WORDPRESS_MARKS = ("wp-content", "wp-includes", "wp-admin", "wp-json", "wordpress")

"""Technology rules, by the part of a response they look at."""

from __future__ import annotations

from . import parse

# Regular expressions over a header's value.
HEADER_PATTERNS = [
    line.split(" ", 2)
    for line in r"""
server \bnginx\b Nginx
server \bapache\b Apache
server \bcloudflare\b Cloudflare
server \bvercel\b Vercel
server \bnetlify\b Netlify
server \bakamaighost\b Akamai
server \bcowboy\b Cowboy
server \bgunicorn\b Gunicorn
server \bopenresty\b OpenResty
server \bcaddy\b Caddy
server \blitespeed\b LiteSpeed
server \benvoy\b Envoy
server \biis\b IIS
server \bpepyaka\b Wix
server \bdeno\b Deno
server \btornado\b Tornado
server \bkestrel\b Kestrel
server \bjetty\b Jetty
server \btomcat\b Tomcat
server \btraefik\b Traefik
x-served-by ^cache- Fastly
via 1\.1\sgoogle Google Cloud CDN
x-powered-by \bnext\.?js\b Next.js
x-powered-by \bexpress\b Express
x-powered-by \bphp\b PHP
x-powered-by \basp\.net\b ASP.NET
x-powered-by w3\stotal\scache W3 Total Cache
x-powered-by \bcraftcms\b Craft CMS
x-powered-by \bplasma\b Jetveo
""".strip().splitlines()
]
# Headers whose presence names a technology.
HEADER_NAMES = parse("""
Cloudflare: cf-ray
Vercel: x-vercel-id
Netlify: x-nf-request-id
CloudFront: x-amz-cf-id, x-amz-cf-pop
Fastly: x-fastly-request-id
Akamai: x-akamai-transformed
Imperva: x-iinfo, incap_ses
StackPath: x-sp-cache
BunnyCDN: cdn-pullzone, cdn-cachedat
Azure CDN: x-azure-ref
Google Cloud CDN: x-goog-gfe-backend-response-time
Shopify: x-shopid
Magento: x-magento-vary
Drupal: x-drupal-cache, x-drupal-dynamic-cache
Wix: x-wix-request-id
Render: x-render-origin-server
LiteSpeed Cache: x-litespeed-cache
Sucuri: x-sucuri-id
""")
# In addresses of scripts.
SCRIPTS = parse("""
Google Analytics: googletagmanager.com/gtag/js
Google Tag Manager: googletagmanager.com/gtm.js
Meta Pixel: connect.facebook.net + fbevents
Hotjar: static.hotjar.com
Segment: cdn.segment.com/analytics
Mixpanel: cdn.mxpnl.com
HubSpot: js.hs-scripts.com, js.hs-analytics.net
Intercom: widget.intercom.io
Drift: js.driftt.com
Crisp: client.crisp.chat
Zendesk: static.zdassets.com
Amplitude: cdn.amplitude.com
Heap: cdn.heapanalytics.com
PostHog: posthog.com
Plausible: plausible.io/js/
Microsoft Clarity: clarity.ms/tag/
Mouseflow: cdn.mouseflow.com
Lucky Orange: cdn.luckyorange.com
Crazy Egg: script.crazyegg.com
Pendo: cdn.pendo.io
FullStory: fullstory.com/s/fs.js
LogRocket: cdn.logrocket.io, cdn.lr-intake.com
Rollbar: cdn.rollbar.com
Sentry: browser.sentry-cdn.com
New Relic: js-agent.newrelic.com, bam.nr-data.net
Datadog: cdn.datadog-agent.com, datadoghq-browser-agent
Rudderstack: cdn.rudderlabs.com
Freshpaint: perfalytics.com, cdn.freshpaint.io
June: cdn.june.so
Keen.io: d26b395fwzu5fz.cloudfront.net/keen
LinkedIn Insight: snap.licdn.com
Pinterest Tag: s.pinimg.com/ct/
TikTok Pixel: analytics.tiktok.com
Snapchat Pixel: sc-static.net/scevent
Microsoft Advertising: bat.bing.com, bat.r.msn.com
Reddit Pixel: alb.reddit.com, rdt.js
Quora Pixel: a.quora.com, q.quora.com
Twitter Pixel: analytics.twitter.com, static.ads-twitter.com
Criteo: static.criteo.net
Taboola: cdn.taboola.com
Outbrain: widgets.outbrain.com
AdRoll: d.adroll.com, cdn.adroll.com
Media.net: contextual.media.net
DoubleClick: securepubads.g.doubleclick.net
Sharethrough: cdn.sharethrough.com
MGID: cdn.mgid.com
Adobe Launch: assets.adobedtm.com
Tealium: tags.tiqcdn.com, tealiumiq.com
Pardot: pi.pardot.com
Marketo: munchkin.marketo.net
Appcues: fast.appcues.com
UserPilot: js.userpilot.io
WalkMe: cdn.walkme.com
Chameleon: fast.trychameleon.com
jQuery: code.jquery.com/jquery, ajax.googleapis.com/ajax/libs/jquery
Bootstrap: stackpath.bootstrapcdn.com/bootstrap
Tailwind CSS: cdn.tailwindcss.com
Font Awesome: use.fontawesome.com, kit.fontawesome.com
Owl Carousel: owlcarousel2
Socket.IO: cdn.socket.io
Google Maps: maps.googleapis.com, maps.google.com/maps
Mapbox: api.mapbox.com, cdn.mapbox.com
HERE Maps: api.here.com, js.api.here.com
Shopify: cdn.shopify.com, sdks.shopifycdn.com
BigCommerce: cdn.bigcommerce.com
Ecwid: app.ecwid.com
Lightspeed: cdn.lightspeedcommerce.com
Snipcart: cdn.snipcart.com
FoxyCart: cdn.foxycart.com
Stripe: js.stripe.com/v3
PayPal: paypal.com/sdk/js
Braintree: js.braintreegateway.com
Square: js.squareup.com, web.squarecdn.com
Klarna: js.klarna.com, klarnaservices.com
Afterpay: static.afterpay.com
Sezzle: widget.sezzle.com
Affirm: sdk.affirm.com
Razorpay: checkout.razorpay.com
Mollie: checkout.mollie.com, js.mollie.com
Tawk.to: embed.tawk.to
Tidio: code.tidio.co
Gorgias: config.gorgias.chat
Freshworks: wchat.freshchat.com, euc-widget.freshworks.com
LiveChat: cdn.livechatinc.com
Olark: static.olark.com
Help Scout: beacon-v2.helpscout.net
Zoho SalesIQ: salesiq.zoho.com, salesiq.zohopublic.com
Userlike: js.userlike.com
Smooch: cdn.smooch.io
Optimizely: cdn.optimizely.com
VWO: dev.visualwebsiteoptimizer.com
AB Tasty: try.abtasty.com
Convert: cdn-3.convertexperiments.com
Mailchimp: chimpstatic.com, list-manage.com
Klaviyo: static.klaviyo.com
ActiveCampaign: trackcmp.net
Omnisend: omnisnippet1.com, omnisrc.com
ConvertKit: f.convertkit.com
Drip: tag.getdrip.com
Customer.io: assets.customer.io
Brevo: sibautomation.com, cdn.brevo.com
MailerLite: assets.mailerlite.com
Sendlane: cdn.sendlane.com
Postscript: cdn.postscript.io
Attentive: cdn.attn.tv, attentive.com/dtag
reCAPTCHA: google.com/recaptcha, gstatic.com/recaptcha
hCaptcha: hcaptcha.com
Cloudflare Turnstile: challenges.cloudflare.com/turnstile
Cookiebot: consent.cookiebot.com
OneTrust: cdn.cookielaw.org, optanon
TrustArc: consent.trustarc.com
iubenda: iubenda.com/cookie-solution
Termly: cdn.termly.io
Vimeo: player.vimeo.com
YouTube: www.youtube.com/iframe_api
Vidyard: play.vidyard.com
Wistia: fast.wistia.com
JW Player: cdn.jwplayer.com
Brightcove: players.brightcove.net
Calendly: assets.calendly.com
Typeform: embed.typeform.com
HubSpot Forms: js.hsforms.net
JotForm: cdn.jotfor.ms, js.jotform.com
Webflow: assets-global.website-files.com, assets.website-files.com
Squarespace: assets.squarespace.com, static1.squarespace.com
Framer: framerusercontent.com, events.framer.com
Weebly: weebly.com/js/, editmysite.com
GoDaddy Builder: img1.wsimg.com
Tilda: static.tildacdn.com, tilda.ws
Strikingly: cdn.strikingly.com
Jimdo: jimdocdn.com
Carrd: carrd.co
Readymag: readymag.com
Contentful: cdn.contentful.com
Sanity: cdn.sanity.io
Prismic: prismic.io
Storyblok: app.storyblok.com, storyblok.com/js
Builder.io: cdn.builder.io
ButterCMS: app.butter.us, cdn.buttercms.com
Algolia: cdn.jsdelivr.net/algoliasearch, algoliasearch-client, algolianet.com, algolia.net
Searchspring: searchspring.net
Searchanise: searchanise.com
Findify: cdn.findify.io
Fast Simon: instantsearchplus.com
Swiftype: api.swiftype.com
accessiBe: acsbapp.com, accessibilityserver.com
UserWay: cdn.userway.org
EqualWeb: cdn.equalweb.com
Nosto: cdn.nosto.com
Barilliance: cdn.barilliance.com
Clerk.io: cdn.clerk.io
Yieldify: cdn.yieldify.com
Dynamic Yield: cdn.dynamicyield.com
Pusher: js.pusher.com
Ably: cdn.ably.io
Weglot: cdn.weglot.com
Twitter Widgets: platform.twitter.com/widgets
Facebook SDK: connect.facebook.net + sdk.js
Instagram Embed: platform.instagram.com
AddThis: cdn.addthis.com
ShareThis: dsms0mj1bbhn4.cloudfront.net/assets/static/share
Adobe RUM: rum.hlx.page
SpeedCurve: cdn.speedcurve.com
""")
# Libraries in addresses of public hosts.
SCRIPTS += parse("""
jQuery: cdnjs.cloudflare.com/ajax/libs/jquery
Vue.js: cdn.jsdelivr.net/npm/vue, unpkg.com/vue, cdnjs.cloudflare.com/ajax/libs/vue
React: unpkg.com/react, cdnjs.cloudflare.com/ajax/libs/react
Alpine.js: cdn.jsdelivr.net/npm/alpinejs, unpkg.com/alpinejs
htmx: unpkg.com/htmx.org, cdn.jsdelivr.net/npm/htmx
Bootstrap: cdn.jsdelivr.net/npm/bootstrap
Materialize: cdnjs.cloudflare.com/ajax/libs/materialize, cdn.jsdelivr.net/npm/materialize
Semantic UI: cdnjs.cloudflare.com/ajax/libs/semantic-ui, cdn.jsdelivr.net/npm/semantic-ui
UIKit: cdnjs.cloudflare.com/ajax/libs/uikit, cdn.jsdelivr.net/npm/uikit
Foundation: cdnjs.cloudflare.com/ajax/libs/foundation, cdn.jsdelivr.net/npm/foundation
Bulma: cdnjs.cloudflare.com/ajax/libs/bulma, cdn.jsdelivr.net/npm/bulma
Tachyons: cdnjs.cloudflare.com/ajax/libs/tachyons, cdn.jsdelivr.net/npm/tachyons
Skeleton: cdnjs.cloudflare.com/ajax/libs/skeleton
Swiper: cdn.jsdelivr.net/npm/swiper, unpkg.com/swiper
GSAP: cdnjs.cloudflare.com/ajax/libs/gsap
Font Awesome: cdnjs.cloudflare.com/ajax/libs/font-awesome
Anime.js: cdnjs.cloudflare.com/ajax/libs/animejs
AOS: unpkg.com/aos, cdn.jsdelivr.net/npm/aos
Lottie: cdnjs.cloudflare.com/ajax/libs/lottie-web, cdn.jsdelivr.net/npm/lottie-web
Owl Carousel: cdnjs.cloudflare.com/ajax/libs/owlcarousel2
Slick: cdnjs.cloudflare.com/ajax/libs/slick-carousel, cdn.jsdelivr.net/npm/slick-carousel
Flickity: cdnjs.cloudflare.com/ajax/libs/flickity
Masonry: cdnjs.cloudflare.com/ajax/libs/masonry, cdn.jsdelivr.net/npm/masonry-layout
Isotope: cdnjs.cloudflare.com/ajax/libs/jquery.isotope, unpkg.com/isotope-layout
Lightbox2: cdnjs.cloudflare.com/ajax/libs/lightbox2
GLightbox: cdn.jsdelivr.net/npm/glightbox
Fancybox: cdnjs.cloudflare.com/ajax/libs/fancybox, cdn.jsdelivr.net/npm/@fancyapps/fancybox
SweetAlert2: cdnjs.cloudflare.com/ajax/libs/sweetalert2, cdn.jsdelivr.net/npm/sweetalert2
Toastr: cdnjs.cloudflare.com/ajax/libs/toastr, cdn.jsdelivr.net/npm/toastr
Select2: cdnjs.cloudflare.com/ajax/libs/select2, cdn.jsdelivr.net/npm/select2
Flatpickr: cdnjs.cloudflare.com/ajax/libs/flatpickr, cdn.jsdelivr.net/npm/flatpickr
Choices.js: cdn.jsdelivr.net/npm/choices.js
Sortable.js: cdn.jsdelivr.net/npm/sortablejs, cdnjs.cloudflare.com/ajax/libs/sortable
Popper.js: unpkg.com/@popperjs, cdnjs.cloudflare.com/ajax/libs/popper.js
Tippy.js: unpkg.com/@tippy.js, cdnjs.cloudflare.com/ajax/libs/tippy.js
Highlight.js: cdnjs.cloudflare.com/ajax/libs/highlight.js, cdn.jsdelivr.net/npm/highlight.js
Prism.js: cdnjs.cloudflare.com/ajax/libs/prism, cdn.jsdelivr.net/npm/prismjs
Moment.js: cdnjs.cloudflare.com/ajax/libs/moment.js, cdn.jsdelivr.net/npm/moment
Lodash: cdnjs.cloudflare.com/ajax/libs/lodash.js, cdn.jsdelivr.net/npm/lodash
Axios: cdnjs.cloudflare.com/ajax/libs/axios, cdn.jsdelivr.net/npm/axios
Socket.IO: cdnjs.cloudflare.com/ajax/libs/socket.io
Chart.js: cdnjs.cloudflare.com/ajax/libs/chart.js, cdn.jsdelivr.net/npm/chart.js
D3.js: cdnjs.cloudflare.com/ajax/libs/d3, cdn.jsdelivr.net/npm/d3
Three.js: cdnjs.cloudflare.com/ajax/libs/three.js, unpkg.com/three
Leaflet: cdnjs.cloudflare.com/ajax/libs/leaflet, unpkg.com/leaflet
""")
# In addresses of links.
LINKS = parse("""
Google Fonts: fonts.googleapis.com, fonts.gstatic.com
Adobe Fonts: use.typekit.net
WordPress: /wp-content/, /wp-includes/
Bootstrap: maxcdn.bootstrapcdn.com/bootstrap
""")
# Beside "generator" in the meta tags.
GENERATORS = parse("""
WordPress: wordpress
Drupal: drupal
Joomla: joomla
Ghost: ghost
Wix: wix.com
WooCommerce: woocommerce
PrestaShop: prestashop
Nuxt.js: nuxt
Gatsby: gatsby
Hugo: hugo
Jekyll: jekyll
Craft CMS: craftcms, craft cms
TYPO3: typo3
Concrete CMS: concrete
Astro: astro
Hexo: hexo
Pelican: pelican
Eleventy: 11ty, eleventy
Contao: contao
Sitecore: sitecore
Kentico: kentico
Umbraco: umbraco
Sitefinity: sitefinity
Episerver: episerver, optimizely cms
dotCMS: dotcms
Tilda: tilda
Readymag: readymag
""")
# In inline scripts.
INLINE = parse("""
Shopify: shopify.theme, shopifyanalytics
Next.js: __next_data__
Nuxt.js: __nuxt__, $nuxt
Remix: __remix
Gatsby: ___gatsby
Astro: astro-island
Google Tag Manager: datalayer + gtm
Meta Pixel: fbq( + init
Matomo: _paq.push
Drupal: drupal + settings
WooCommerce: woocommerce_params, wc_add_to_cart
Magento: x-magento-init, data-mage-init
ReCharge: rechargewidget, rechargepayments
Klaviyo: _learnq + klaviyo
Bubble: bubble.io
Notion: notion-static.com
Substack: substackcdn.com, substack.com
Schema.org JSON-LD: application/ld+json
Volusion: volusion.com
Shift4Shop: shift4shop.com, 3dcart.com
""")
# Anywhere in the page (compared in lower case).
MARKUP = parse("""
React: data-reactroot, data-reactid
Angular: ng-version=
AngularJS: ng-app, ng-controller
Next.js: id="__next"
Nuxt.js: id="__nuxt", data-n-head
Gatsby: id="___gatsby"
Astro: astro-island, data-astro-
Webflow: data-wf-page, data-wf-site
Squarespace: data-squarespace
Wix: static.wixstatic.com, parastorage.com
WordPress: /wp-content/, /wp-includes/
Shopify: cdn.shopify.com, shopify-section
Drupal: /sites/default/files/
Magento: data-mage-init, x-magento-init
WooCommerce: woocommerce-page, wc-block
reCAPTCHA: class="g-recaptcha"
hCaptcha: class="h-captcha"
Cloudflare Turnstile: class="cf-turnstile"
BigCommerce: cdn.bigcommerce.com
Ecwid: app.ecwid.com
Framer: framerusercontent.com
Bubble: bubble.io
Notion: notion-static.com, notion.site
Substack: substackcdn.com
Google AdSense: adsbygoogle, pagead2.googlesyndication
Google Publisher Tag: googletag.cmd, securepubads
OpenCart: catalog/view/theme
Joomla: /components/com_, option=com_
Open Graph: property="og:
""")
# Regular expressions over the page.
MARKUP_PATTERNS = [("data-v-[0-9a-f]{7,8}", "Vue.js"), ("svelte-[a-z0-9]{5,7}", "Svelte")]
# In any address.
ADDRESSES = parse("""
jsDelivr: cdn.jsdelivr.net
cdnjs: cdnjs.cloudflare.com
unpkg: unpkg.com
Cloudinary: cloudinary.com
Imgix: imgix.net
WooCommerce: wp-content/plugins/woocommerce
Next.js: /_next/
Nuxt.js: /_nuxt/
Astro: /_astro/
Firebase: firebaseapp.com, firebase.google.com, __/firebase/
Supabase: supabase.co
""")
# Content delivery networks, the first that holds: headers present, else the server's name.
CDN = [
    ("cloudflare", ["cf-ray"], "cloudflare"),
    ("cloudfront", ["x-amz-cf-id", "x-amz-cf-pop"], ""),
    ("fastly", ["x-fastly-request-id"], ""),
    ("akamai", ["x-akamai-transformed"], "akamaighost"),
    ("vercel", ["x-vercel-id"], "vercel"),
    ("netlify", ["x-nf-request-id"], "netlify"),
    ("sucuri", ["x-sucuri-id"], ""),
    ("imperva", ["x-iinfo"], ""),
    ("bunnycdn", ["cdn-pullzone"], ""),
    ("stackpath", ["x-sp-cache"], ""),
    ("azure", ["x-azure-ref"], ""),
]
# Blocked responses, the first that holds; a part after @ is a header.
BLOCKED = parse("""
cloudflare: checking your browser + cloudflare, attention required + cloudflare
sucuri: sucuri website firewall, access denied - sucuri
imperva: incapsula incident, _incapsula_resource
perimeterx: access to this page has been denied + perimeterx
datadome: datadome + your request has been blocked
awswaf: request could not be satisfied + @x-amz-cf-id
modsecurity: mod_security, modsecurity
datadome: @x-datadome
perimeterx: @x-px
""")

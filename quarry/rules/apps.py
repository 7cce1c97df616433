"""App rules: hosts and markers of shop apps, folders and markers of content-system plugins."""

from __future__ import annotations

from . import parse

# Hosts and paths that shop apps are served from.
SHOP_HOSTS = parse("""
Judge.me: cdn.judge.me
Yotpo Reviews: staticw2.yotpo.com, cdn-widgetsrepository.yotpo.com
Shopify Product Reviews: productreviews.shopifycdn.com
Loox: loox.io
Stamped.io: cdn1.stamped.io, stamped.io/assets
Okendo: cdn.okereviews.com
Reviews.io: d3hw6dc1ow8pp2.cloudfront.net/reviewsio
Trustpilot: widget.trustpilot.com
Rivyo Reviews: cdn.reviewscofe.com
Fera.ai: cdn.fera.ai
Ryviu: cdn.ryviu.com
Ali Reviews: alireviews.fireapps.io
Klaviyo: static.klaviyo.com
Omnisend: omnisnippet1.com, omnisrc.com
Sendlane: cdn.sendlane.com
MailerLite: assets.mailerlite.com
Drip: app.drip.com
Postscript: cdn.postscript.io
Attentive: cdn.attn.tv, attentive.com/dtag
Brevo: cdn.shopify.com/proxy/brevo
Mailchimp: chimpstatic.com, list-manage.com
ConvertKit: f.convertkit.com
MailMunch: generic-mailmunch
PushOwl: cdn.pushowl.com
OneSignal: onesignal.com
Seguno: cdn.seguno.com
Sendwithus: cdn.sendwithus.com
Flodesk: go.flodesk.com
Privy: widget.privy.com
Justuno: cdn.justuno.com
OptiMonk: front.optimonk.com, onsite.optimonk.com
Wisepops: app.wisepops.com
Wheelio: assets.wheelio-app.com
Poptin: cdn.popt.in
Rivo Popups: cdn.rivo.io
Sumo: sumo.com/sumo.js, load.sumo.com
OptinMonster: optinmonster.com
Smile.io: js.smile.io
LoyaltyLion: sdk.loyaltylion.net, loyaltylion.com
Yotpo Loyalty: cdn.yotpo.com/widgets/loyalty
Rivo: cdn.rivo.io
Growave: cdn.growave.io
PageFly: pagefly.io
Shogun: getshogun.com, lib.getshogun.com
GemPages: gempages.net
Zipify Pages: cdn.zipify.com/zipifypages
EComposer: cdn.ecomposer.io
Replo: replo.app
ReCharge: rechargepayments.com
Bold Commerce: boldcommerce.com, boldapps.net
Skio: skio.com
PayWhirl: paywhirl.com
Appstle Subscriptions: appstle.com
Seal Subscriptions: seal-subscriptions.com
Recurpay: recurpay.com
Rebuy: cdn.rebuyengine.com
Recomify: cdn.recomify.com
Bold Upsell: cdn.bold.ninja
Selleasy: selleasy.com
ReConvert: reconvert.io
Zipify OCU: cdn.zipify.com/ocu
HoneyComb: honeycomb-upsell.com
Vitals: vitals.co
Bundle Builder: widgets.bundlebuilder.com
FoxKit: foxkit.app
Frequently Bought Together: cdn.frequently-bought-together.com
AfterSell: aftersell.com
Pumper Bundles: cdn.pumper.app
Gorgias: config.gorgias.chat
Tidio: code.tidio.co
Tawk.to: embed.tawk.to
Reamaze: reamaze.js
LiveChat: cdn.livechatinc.com
ChatBot: cdn.chatbot.com
Loop Returns: loopreturns.com
Returnly: returnly.com
ReturnGO: cdn.returngo.ai
AfterShip: app.aftership.com
Parcel Panel: cdn.parcelpanel.com
Track123: track123.com
17TRACK: cdn.17track.net
TrackingMore: trackingmore-service.com
Route: cdn.route.com
ShippingChimp: shippingchimp.com
Tracktor: tracktor.app
Afterpay: static.afterpay.com, afterpay.com/afterpay.js
Klarna: js.klarna.com, klarnaservices.com
Sezzle: widget.sezzle.com
Shop Pay: cdn.shoppay.io
Affirm: sdk.affirm.com
Wishlist Plus: swymrelay.com, swym.it
Back in Stock: cdn.back-in-stock.com
Notify! Back in Stock: notifyapp.io
Yanet Back in Stock: cdn.yanet.me
Boost Product Filter: cdn.boostcommerce.net
Searchspring: searchspring.net
Searchanise: searchanise.com
Findify: cdn.findify.io
Fast Simon: instantsearchplus.com
FOMO: cdn.fomo.com
Nudgify: cdn.nudgify.com
ProveSource: provesrc.com
Hextom: cdn.hextom.com
accessiBe: acsbapp.com, accessibilityserver.com
UserWay: cdn.userway.org
EqualWeb: cdn.equalweb.com
Pandectes GDPR: cdn.pandectes.io
Termly: cdn.termly.io
iubenda: iubenda.com/cookie-solution
Cookie Script: cookie-script.com
Cookiebot: consent.cookiebot.com
OneTrust: cdn.cookielaw.org
Consentmo GDPR: cdn.consentmo.com
Complianz: cdn.complianz.io
Weglot: cdn.weglot.com
Langify: cdn.langify-app.com
LangShop: cdn.langshop.app
Transcy: cdn.transcy.io
Instafeed: instafeed.nfcube.com
Socialwidget: cdn.socialwidget.app
Elfsight: cdn.elfsight.com
Pinterest for Shopify: assets.pinterest.com/ext/shopify
Tapcart: cdn.tapcart.com
UpPromote: cdn.uppromote.com
GOAFFPRO: cdn.goaffpro.com
BixGrow: cdn.bixgrow.com
ShareASale: cdn.shareasale.com
Awin: cdn.awin1.com
Printful: printful.com/js
Printify: printify.com
Gelato: gelato.com
DSers: dsers.com
CJdropshipping: cjdropshipping.com
AutoDS: autods.com
Customily: cdn.customily.com
PC Product Options: cdn.productcustomizer.com
Triple Whale: triplewhale.com
Elevar: cdn.elevar.io
Stape: cdn.stape.io
wetracked: wetracked.io
Kiwi Size Chart: cdn.kiwisizing.com
Stockist: stockist.co
Blockify: cdn.blockify.co
Zipify: cdn.zipify.com
Geolocation: geolocation-app.shopifycdn.com
Tolstoy: cdn.tolstoy.com
AdRoll: cdn.adroll.com
Yieldify: cdn.yieldify.com
Nosto: cdn.nosto.com
Barilliance: cdn.barilliance.com
Clerk.io: cdn.clerk.io
Bold: saasler.com
Lightfunnels: lightfunnels.com
SpurIT: cdn.spurit.com
Tabs Studio: tab-station.com
Releasit COD Form: releasit.io
Cowlendar: cowlendar.com
Booster: boostpageoptimizer.com
Discount Ninja: cdn.discountninja.io
""")
# What shop apps leave in a page.
SHOP_MARKERS = parse("""
Judge.me: jdgm-widget, jdgm-review
Yotpo Reviews: class="yotpo", yotpo-main-widget
PageFly: pf-element, data-pf-
Shogun: shg-c, shg-row
GemPages: gem-page, gp-page
Shop Pay: shopify-payment-terms, shopify-payment-button
Afterpay: afterpay-placement
Klarna: klarna-placement
Sezzle: sezzle-widget
Smile.io: smile-launcher, smile-dock
Loox: loox-rating, id="looxreviews"
Stamped.io: stampedfn.init, <!-- stamped
Gorgias: gorgias-chat-widget
ReCharge: rechargewidget, rc_container
EComposer: ecomposer-section
Rebuy: rebuy-widget, data-rebuy
FoxKit: data-foxkit
Vitals: class="vitals-
Triple Whale: data-triple-whale
Consentmo GDPR: consentmo-gdpr
Pandectes GDPR: pandectes-consent
Releasit COD Form: releasit-cod
Growave: growave-, data-growave
UpCart: upcart-, slide-cart
BUCKS Currency: data-bucks-
Transcy: transcy-, data-transcy
Zipify: data-zipify
""")
# Plugin folders.
_PLUGINS = """
Yoast SEO: wordpress-seo
Rank Math: seo-by-rank-math
All in One SEO: all-in-one-seo-pack
The SEO Framework: the-seo-framework
Schema Pro: schema-and-structured-data-for-wp
Elementor: elementor
WPBakery: js_composer
Divi Builder: divi-builder
Beaver Builder: beaver-builder-lite-version
Beaver Builder Pro: bb-plugin
Avada Builder: fusion-builder
Oxygen Builder: oxygen
Bricks Builder: bricks
GenerateBlocks: generateblocks
Kadence Blocks: kadence-blocks
Stackable: stackable-ultimate-gutenberg-blocks
Spectra: spectra
Contact Form 7: contact-form-7
WPForms: wpforms-lite
WPForms Pro: wpforms
Gravity Forms: gravityforms
Formidable Forms: formidable
Ninja Forms: ninja-forms
Forminator: forminator
Fluent Forms: fluentform
Everest Forms: everest-forms
WooCommerce: woocommerce
Easy Digital Downloads: easy-digital-downloads
WooCommerce Blocks: woo-gutenberg-products-block
WooCommerce Payments: woocommerce-payments
WooCommerce Stripe: woo-stripe-payment
CheckoutWC: checkout-for-woocommerce
WooCommerce Subscriptions: woocommerce-subscriptions
WooCommerce Memberships: woocommerce-memberships
WooCommerce Bookings: woocommerce-bookings
MonsterInsights: google-analytics-for-wordpress
Google Site Kit: google-site-kit
Matomo Analytics: matomo
PixelYourSite: pixelyoursite
Independent Analytics: independent-analytics
WP Rocket: wp-rocket
W3 Total Cache: w3-total-cache
LiteSpeed Cache: litespeed-cache
WP Super Cache: wp-super-cache
Autoptimize: autoptimize
WP Fastest Cache: wp-fastest-cache
Cache Enabler: cache-enabler
SG Optimizer: sg-cachepress
Breeze: breeze
NitroPack: nitropack
Perfmatters: perfmatters
FlyingPress: flying-press
Smush: wp-smushit
ShortPixel: shortpixel-image-optimiser
Imagify: imagify
EWWW Optimizer: ewww-image-optimizer
Optimole: optimole-wp
WebP Converter: webp-converter-for-media
Wordfence: wordfence
Sucuri Security: sucuri-scanner
Really Simple SSL: really-simple-ssl
AIOS Security: all-in-one-wp-security-and-firewall
Limit Login Attempts: limit-login-attempts-reloaded
Jetpack: jetpack
WPML: sitepress-multilingual-cms
Polylang: polylang
TranslatePress: translatepress-multilingual
Weglot: weglot
MC4WP Mailchimp: mailchimp-for-wp
Mailchimp WooCommerce: mailchimp-for-woocommerce
MailPoet: mailpoet
HubSpot: leadin
ConvertKit: convertkit
OptinMonster: optinmonster
Sumo: sumo
Slider Revolution: revslider
MetaSlider: ml-slider
Smart Slider 3: smart-slider-3
Envira Gallery: envira-gallery-lite
Modula Gallery: modula-best-grid-gallery
NextGEN Gallery: nextgen-gallery
Social Warfare: social-warfare
AddToAny Share: add-to-any
Smash Balloon Instagram: instagram-feed
Smash Balloon Facebook: custom-facebook-feed
Smash Balloon YouTube: feeds-for-youtube
TablePress: tablepress
WP-PageNavi: wp-pagenavi
ACF: advanced-custom-fields
ACF Pro: advanced-custom-fields-pro
LearnDash: sfwd-lms
LifterLMS: lifterlms
MemberPress: memberpress
Restrict Content Pro: restrict-content-pro
Tutor LMS: tutor
Sensei LMS: sensei-lms
Paid Memberships Pro: paid-memberships-pro
BuddyPress: buddypress
bbPress: bbpress
UpdraftPlus: updraftplus
BackWPup: backwpup
Duplicator: duplicator
All-in-One WP Migration: all-in-one-wp-migration
Cookie Notice: cookie-notice
CookieYes: cookie-law-info
Complianz: complianz-gdpr
GDPR Cookie Compliance: gdpr-cookie-compliance
iubenda: iubenda-cookie-law-solution
Akismet: akismet
AMP: amp
WP Mail SMTP: wp-mail-smtp
Header Footer Code Manager: header-footer-code-manager
Code Snippets: code-snippets
Redirection: redirection
Hustle: wordpress-popup
Classic Editor: classic-editor
"""
PLUGINS = [(name, [[f"/wp-content/plugins/{folder}/"] for (folder,) in any_]) for name, any_ in parse(_PLUGINS)]
# What plugins leave in a page.
PLUGIN_MARKERS = parse("""
Yoast SEO: <!-- this site is optimized + yoast
Rank Math: <!-- rank math seo
All in One SEO: <!-- all in one seo
WP Rocket: is like a rocket + wp rocket
W3 Total Cache: performance optimized by w3 total cache
LiteSpeed Cache: page generated by litespeed
WP Super Cache: cached page generated by wp-super-cache
Autoptimize: <!-- autoptimize
Contact Form 7: class="wpcf7", wpcf7-form
WPForms: wpforms-container
Gravity Forms: gform_wrapper
MC4WP Mailchimp: class="mc4wp-form"
TablePress: class="tablepress"
WP-PageNavi: wp-pagenavi
Slider Revolution: rs-module-wrap, class="rev_slider
MetaSlider: class="metaslider"
Cookie Notice: cookie-notice-container, id="cookie-notice"
CookieYes: id="cky-consent", cky-consent-bar
Complianz: <!-- complianz, class="cmplz-
BuddyPress: buddypress + class="bp-
bbPress: bbpress-forums
LearnDash: learndash-wrapper, sfwd-
LifterLMS: class="llms-
WPML: wpml-ls-
""")

"""Lists that filters use unless the caller brings others."""

# Platforms that host others' sites; a name that ends in one is no site of its own.
SHARED_HOSTS = """
pages.dev workers.dev cloudflaressl.com cloudflare-dns.com trycloudflare.com herokuapp.com herokuapp.ssl.com azurewebsites.net cloudfront.net amazonaws.com s3.amazonaws.com elasticbeanstalk.com compute.amazonaws.com
vercel.app netlify.app github.io gitlab.io web.app firebaseapp.com appspot.com cloudfunctions.net run.app railway.app render.com fly.dev cyclic.app deta.dev repl.co glitch.me
pantheonsite.io wpengine.com kinsta.cloud turbifycdn.com myshopify.com bigcartel.com squarespace.com wixsite.com weebly.com wordpress.com tumblr.com blogspot.com medium.com ghost.io webflow.io carrd.co notion.site airtableusercontent.com
loca.lt ngrok.io quickconnect.to duckdns.org freeddns.org no-ip.org dynu.net afraid.org nip.io xip.io sslip.io traefik.me localtest.me lvh.me vcap.me plex.direct
nflxvideo.net
mongodb.net zendesk.com salesforce.com force.com hubspot.com mailchimp.com sendgrid.net mandrillapp.com sparkpostmail.com intercom.io segment.com amplitude.com mixpanel.com launchdarkly.com
""".split()

# Suffixes of names worth a crawl.
HIGH_VALUE_TLDS = """
com net io co org biz us ca com.ca sg com.sg com.au hk com.hk uk co.uk ie nz co.nz nl se dk no fi de ch fr es it at be lu is ee il co.il jp co.jp ae com.sa qa com.br
""".split()

# Names that are registries or hosts of others, not sites.
REGISTRIES = """
uk.com us.com eu.com cn.com de.com br.com ru.com sa.com za.com se.com no.com kr.com jp.com hu.com it.com uk.net se.net eu.org
ddns.net dyndns.org no-ip.org no-ip.com no-ip.biz hopto.org sytes.net zapto.org myftp.org myftp.biz serveftp.com servegame.com redirectme.net myftpupload.com synology.me
co.uk co.za co.in co.jp co.kr co.nz co.il com.au com.br com.cn com.hk com.mx com.sg com.tw com.ar com.co com.tr com.ua com.vn com.ng com.pk
org.uk org.au org.nz org.br org.il org.za net.au net.br net.cn net.in ac.uk gov.uk gov.br gov.au gov.in edu.au edu.br edu.cn
adv.br ind.br inf.br eng.br mus.br bio.br art.br eti.br eco.br esp.br etc.br pp.ua my.id web.id or.id go.id ac.id
herokuapp.com azurewebsites.net cloudfront.net netlify.app vercel.app pages.dev fly.dev onrender.com railway.app web.app firebaseapp.com github.io gitlab.io bitbucket.io
blogspot.com wordpress.com tumblr.com squarespace.com wixsite.com weebly.com shopify.com myshopify.com godaddysites.com godaddywebsitebuilder.com
""".split()

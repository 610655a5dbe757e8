mysql: [Warning] Using a password on the command line interface can be insecure.
Table	Create Table
shop_parcel	CREATE TABLE "shop_parcel" (\n  "parcel_no" int NOT NULL AUTO_INCREMENT,\n  "shelf" varchar(12) NOT NULL,\n  "weight_grams" mediumint unsigned NOT NULL DEFAULT '0',\n  "is_fragile" tinyint(1) NOT NULL DEFAULT '1',\n  "route_note" text,\n  "pickup_date" datetime NOT NULL,\n  "scanned" datetime(6) DEFAULT NULL,\n  PRIMARY KEY ("parcel_no"),\n  KEY "by_shelf" ("shelf","pickup_date")\n)

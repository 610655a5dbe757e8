CREATE TABLE `shop_ticks` (
  `id` int NOT NULL,
  `best_score` mediumint DEFAULT NULL,
  `city` varchar(30) DEFAULT NULL,
  PRIMARY KEY (`id`)
) ENGINE=InnoDB

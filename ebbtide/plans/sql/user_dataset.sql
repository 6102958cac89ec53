WITH engaged AS (
  SELECT user_pseudo_id,
         min(event_timestamp) AS first_us,
         max(event_timestamp) AS last_us,
         max_by(struct(geo.country AS country, device.operating_system AS os, device.language AS lang),
                struct(event_timestamp, event_id)) AS newest
  FROM {events}
  WHERE event_name = :engagement_event
  GROUP BY user_pseudo_id
),
log_end AS (
  SELECT max(event_timestamp) AS end_us FROM {events} WHERE event_name = :engagement_event
),
first_day AS (
  SELECT e.user_pseudo_id,
         count_if(event_name = 'user_engagement') AS cnt_user_engagement,
         count_if(event_name = 'level_start_quickplay') AS cnt_level_start_quickplay,
         count_if(event_name = 'level_end_quickplay') AS cnt_level_end_quickplay,
         count_if(event_name = 'level_complete_quickplay') AS cnt_level_complete_quickplay,
         count_if(event_name = 'level_reset_quickplay') AS cnt_level_reset_quickplay,
         count_if(event_name = 'post_score') AS cnt_post_score,
         count_if(event_name = 'spend_virtual_currency') AS cnt_spend_virtual_currency,
         count_if(event_name = 'ad_reward') AS cnt_ad_reward,
         count_if(event_name = 'challenge_a_friend') AS cnt_challenge_a_friend,
         count_if(event_name = 'completed_5_levels') AS cnt_completed_5_levels,
         count_if(event_name = 'use_extra_steps') AS cnt_use_extra_steps
  FROM {events} e
  JOIN engaged u ON e.user_pseudo_id = u.user_pseudo_id
  WHERE timestamp_micros(e.event_timestamp)
        <= timestampadd(HOUR, :churn_hours, timestamp_micros(u.first_us))
  GROUP BY e.user_pseudo_id
)
SELECT timestamp_micros(first_us) AS user_first_engagement,
       u.user_pseudo_id,
       if(timestamp_micros(first_us)
            > timestampadd(HOUR, -:censor_hours, timestamp_micros(end_us)), 0, 1) AS is_enable,
       if(timestamp_micros(last_us)
            <= timestampadd(MINUTE, :bounce_minutes, timestamp_micros(first_us)), 1, 0) AS bounced,
       if(u.user_pseudo_id IS NOT NULL, newest.country, NULL) AS country_name,
       if(u.user_pseudo_id IS NOT NULL, newest.os, NULL) AS device_os,
       if(u.user_pseudo_id IS NOT NULL, newest.lang, NULL) AS device_lang,
       f.* EXCEPT (user_pseudo_id),
       if(timestamp_micros(last_us)
            < timestampadd(HOUR, :churn_hours, timestamp_micros(first_us)), 1, 0) AS churned
FROM engaged u
CROSS JOIN log_end
LEFT JOIN first_day f ON u.user_pseudo_id = f.user_pseudo_id
